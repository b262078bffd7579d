"""Secrets in texts: fixed patterns plus a sliding-window entropy scan, in column expressions.

Base spans come from three patterns. The scan looks at every stretch of 20 or more
token characters, keeps the character counts of a window up to date as it moves (one
character in, one out) and reports the stretch covered by windows whose Shannon entropy
reaches the limit of the stretch's character class. An allow-list takes back what is
no secret. All offsets are code points, ends exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fenland.llm.common import fresh

# fixed values: the patterns, the group whose length counts, the least length
KINDS = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]{16,}", 0, 20),  # a run of 20 from its first AKIA, so a shorter one holds no match either
    "hex": (r"[0-9a-f]{24,}", 0, 24),  # maximal runs: the same matches as runs of any length, cut by length
}
ENTROPY = "entropy"
ORDER = {kind: k for k, kind in enumerate((*KINDS, ENTROPY))}

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
# bits per character in a window of 20, by class: digits and a-f in one case; digits with letters of
# both cases, of lower case, of upper case (base32 keys); letters alone, where joined words reach 4.1
LIMITS = {"hex": 3.0, "mixed": 3.8, "lower": 3.8, "upper": 3.6, "letters": 4.2}
IDENTIFIER = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
# allow-list: identifiers and fillers that look random but are not secret
ALLOWED = (
    r"(?i)example|sample|dummy|placeholder|changeme|your[_-]|xxxx|"
    r"0123456789|abcdefghij|qwertyuiop|" + IDENTIFIER
)

def _located(text: Column, pattern: str, group: int) -> Column:
    """array<struct(start, end, value)> of the pattern's matches; value is the group."""
    pattern_column = F.lit(pattern)
    matches = F.regexp_extract_all(text, pattern_column, F.lit(0))
    # what lies between the matches gives their places
    parts = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"),
        matches.alias("match"),
        F.regexp_extract_all(text, pattern_column, F.lit(group)).alias("value"),
    )
    size = lambda column: F.coalesce(F.length(column), F.lit(0)).cast("long")
    kind = "array<struct<start:bigint,end:bigint,value:string>>"
    walked = F.aggregate(
        parts,
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(kind).alias("found")),
        lambda s, p: F.struct(
            (s["at"] + size(p["gap"]) + size(p["match"])).alias("at"),
            F.when(p["match"].isNull(), s["found"])
            .otherwise(
                F.array_append(
                    s["found"],
                    F.struct(
                        (s["at"] + size(p["gap"])).alias("start"),
                        (s["at"] + size(p["gap"]) + size(p["match"])).alias("end"),
                        p["value"].alias("value"),
                    ),
                )
            )
            .alias("found"),
        ),
        lambda s: s["found"],
    )
    return F.when(text.rlike(pattern), walked).otherwise(F.array().cast(kind))


def _base(text: Column, kind: str) -> Column:
    pattern, group, least = KINDS[kind]
    kept = F.filter(_located(text, pattern, group), lambda m: F.length(m["value"]) >= least)
    return F.transform(kept, lambda m: F.struct(m["start"].alias("start"), F.lit(ORDER[kind]).alias("rank"), m["end"].alias("end")))


def _weight(n: Column) -> Column:
    """n log2 n, 0 for none; from a table, as counts never pass the window's length."""
    table = F.array(*[F.lit(k * math.log2(k) if k > 1 else 0.0) for k in range(WINDOW + 1)])
    return F.element_at(table, (n + 1).cast("int"))


def _hot(codes: Column, limit: Column) -> Column:
    """struct(first, last): starts of the first and the last window that reach the limit, -1 if none.

    The state carries the counts of the window and the sum of n log2 n over them. A
    move puts one character in or takes one out and corrects the sum for this count
    alone; the window's entropy is log2(20) - sum / 20.
    """
    most = (F.lit(math.log2(WINDOW)) - limit) * WINDOW  # the sum at the limit
    move = lambda code, by, at: F.struct(code.alias("code"), F.lit(by).alias("by"), at.alias("at"))
    moves = F.flatten(
        F.transform(
            F.sequence(F.lit(1), F.size(codes)),
            lambda at: F.array(
                move(F.when(at > WINDOW, F.element_at(codes, F.greatest(at - WINDOW, F.lit(1)))).otherwise(F.lit(0)), -1, at),
                move(F.element_at(codes, at), 1, at),
            ),
        )
    )

    def step(s: Column, m: Column) -> Column:
        old = F.element_at(s["counts"], F.greatest(m["code"], F.lit(1)))
        total = F.when(m["code"] == 0, s["sum"]).otherwise(s["sum"] + _weight(old + m["by"]) - _weight(old))
        hot = (m["by"] == 1) & (m["at"] >= WINDOW) & (total <= most + 1e-9)
        start = m["at"] - WINDOW
        return F.struct(
            F.transform(s["counts"], lambda n, k: F.when(k + 1 == m["code"], n + m["by"]).otherwise(n)).alias("counts"),
            total.alias("sum"),
            F.when(hot & (s["first"] < 0), start).otherwise(s["first"]).alias("first"),
            F.when(hot, start).otherwise(s["last"]).alias("last"),
        )

    zero = F.struct(
        F.array_repeat(F.lit(0), len(ALPHABET)).alias("counts"), F.lit(0.0).alias("sum"), F.lit(-1).alias("first"), F.lit(-1).alias("last")
    )
    return F.aggregate(moves, zero, step, lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last")))


def _limit(value: Column) -> Column:
    """Limit of the value's class; null without letters."""
    digit, lower, upper = (value.rlike(p) for p in ("[0-9]", "[a-z]", "[A-Z]"))
    return (
        F.when(digit & value.rlike("^([0-9a-f]+|[0-9A-F]+)$") & (lower | upper), LIMITS["hex"])
        .when(digit & lower & upper, LIMITS["mixed"])
        .when(digit & lower, LIMITS["lower"])
        .when(digit & upper, LIMITS["upper"])
        .when(lower | upper, LIMITS["letters"])
    )


def _left(run: Column, base: Column) -> Column:
    """array<struct(start, value)>: what the base spans, in order of their starts, leave of a run in pieces of a window at least."""
    met = F.filter(base, lambda b: (b["start"] < run["end"]) & (run["start"] < b["end"]))
    last = F.struct(run["end"].alias("start"), F.lit(0).alias("rank"), run["end"].alias("end"))

    def step(s: Column, b: Column) -> Column:
        piece = F.struct(s["at"].alias("start"), F.substring(run["value"], (s["at"] - run["start"] + 1).cast("int"), (b["start"] - s["at"]).cast("int")).alias("value"))
        return F.struct(
            F.greatest(s["at"], b["end"]).alias("at"),
            F.when(b["start"] - s["at"] >= WINDOW, F.array_append(s["pieces"], piece)).otherwise(s["pieces"]).alias("pieces"),
        )

    zero = F.struct(run["start"].alias("at"), F.array().cast("array<struct<start:bigint,value:string>>").alias("pieces"))
    return F.aggregate(F.array_append(met, last), zero, step, lambda s: s["pieces"])


def _scanned(text: Column, base: Column) -> Column:
    """Spans of the entropy scan beside the base spans; the allow-list is asked about each span alone."""
    runs = F.filter(_located(text, CANDIDATE, 0), lambda m: ~m["value"].rlike("(?i)" + IDENTIFIER))
    codes = lambda value: F.transform(F.split(value, "", -1), lambda c: F.call_function("locate", c, F.lit(ALPHABET)))
    # fields of their own, so that no step of the scan works them out again
    read = F.transform(
        F.flatten(F.transform(runs, lambda m: _left(m, base))),
        lambda p: F.struct(p["start"].alias("start"), p["value"].alias("value"), _limit(p["value"]).alias("limit"), codes(p["value"]).alias("codes")),
    )
    # entropy is at most the logarithm of the number of different characters
    free = F.filter(read, lambda p: F.log2(F.size(F.array_distinct(p["codes"]))) >= p["limit"] - 1e-9)
    hot = F.transform(free, lambda p: F.struct(p["start"].alias("start"), p["value"].alias("value"), _hot(p["codes"], p["limit"]).alias("hot")))
    stretch = lambda h: F.substring(h["value"], h["hot"]["first"] + 1, h["hot"]["last"] + WINDOW - h["hot"]["first"])
    spans = F.transform(
        F.filter(hot, lambda h: (h["hot"]["first"] >= 0) & ~stretch(h).rlike(ALLOWED)),
        lambda h: F.struct(
            (h["start"] + h["hot"]["first"]).alias("start"),
            F.lit(ORDER[ENTROPY]).alias("rank"),
            (h["start"] + h["hot"]["last"] + WINDOW).alias("end"),
        ),
    )
    return F.when(text.rlike(CANDIDATE), spans).otherwise(F.array().cast("array<struct<start:bigint,rank:int,end:bigint>>"))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(kind) for kind in ORDER])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def find_secrets(docs: DataFrame, text_column: str = "text", base_name: str = "base_spans", all_name: str = "all_spans") -> DataFrame:
    """The rows with `base_spans` and `all_spans`: array<struct<start, rank, end>> by start, then rank.

    rank is the place of the kind among assign, access, hex, entropy. Null and empty
    texts have empty arrays. Columns of the input with the two names are replaced, so `fresh` ones keep them.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    ordered = lambda spans: F.array_sort(spans)  # noqa: E731  structs compare by start, then rank
    found = docs.withColumn(base_name, ordered(F.concat(*[_base(text, kind) for kind in KINDS])))
    return found.withColumn(all_name, ordered(F.concat(base_name, _scanned(text, F.col(base_name)))))


def secret_digests(docs: DataFrame, text_column: str = "text", id_column: str = "doc_id") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy of every row."""
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    count = lambda spans, kind: F.size(F.filter(spans, lambda s: s["rank"] == ORDER[kind])).cast("long")
    found = find_secrets(rows)
    return found.select(
        "doc_id",
        *[count(F.col("base_spans"), kind).alias(f"n_{kind}") for kind in KINDS],
        F.sha2(_joined(F.col("base_spans")), 256).alias("base_sha256"),
        _joined(F.col("all_spans")).alias("spans"),
        count(F.col("all_spans"), ENTROPY).alias("n_entropy"),
    )


def redact(docs: DataFrame, text_column: str = "text", mark: str = "[secret]") -> DataFrame:
    """The rows with every span of the text, merged where spans overlap, replaced by a mark.

    Null texts stay null; all other columns, whatever their names, stay as they are.
    """
    text = F.col(text_column)
    # names that no column of the rows has
    base, spans = fresh("base", docs), fresh("spans", docs)
    covered = fresh("covered", docs)
    walked = F.aggregate(
        F.col(spans),
        F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")),
        lambda s, m: F.struct(
            F.greatest(s["at"], m["end"]).alias("at"),
            F.when(
                m["start"] >= s["at"],
                F.concat(s["out"], F.substring(text, s["at"].cast("int") + 1, (m["start"] - s["at"]).cast("int")), F.lit(mark)),
            )
            .otherwise(s["out"])
            .alias("out"),
        ),
    )
    left = F.concat(F.col(covered)["out"], F.substring(text, F.col(covered)["at"].cast("int") + 1, F.length(text)))
    found = find_secrets(docs, text_column, base, spans)
    cleaned = found.withColumn(covered, F.when(F.size(spans) > 0, walked))
    return cleaned.withColumn(text_column, F.when(F.size(spans) > 0, left).otherwise(text)).select(*[f"`{c}`" for c in docs.columns])
