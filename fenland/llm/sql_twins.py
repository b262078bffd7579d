"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from fenland.llm import manifest, personal_data, secrets, sharding


def _mix(value: str, key: int) -> str:
    p = sharding.PRIME
    x = f"(({value} + {key}) % {p})"
    x = f"(({x} * {x} + {key}) % {p})"
    return f"(({x} * {x}) % {p})"


def _step(x: str) -> str:
    """One pass of the network as nested columns; a and b are the mixed radix."""
    k = sharding.KEYS
    return f"""
      SELECT * EXCLUDE (l0, r0, l1, r1, l2, r2), l2 + r2 * a AS y FROM (
        SELECT *, (r1 + {_mix("l2", k[3])}) % b AS r2 FROM (
          SELECT *, (l1 + {_mix("r1", k[2])}) % a AS l2 FROM (
            SELECT *, (r0 + {_mix("l1", k[1])}) % b AS r1 FROM (
              SELECT *, (l0 + {_mix("r0", k[0])}) % a AS l1 FROM (
                SELECT *, {x} % a AS l0, {x} // a AS r0 FROM source)))))"""


# every value of the mixed radix goes through the network once; the walk then follows
# the table until it is inside the domain
OP6_SQL = f"""
WITH RECURSIVE
bits AS (
  SELECT list(c ORDER BY i) AS crc_table FROM (
    SELECT i, list_reduce(list_prepend(i::UBIGINT, [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]),
      lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS c
    FROM range(256) t(i))),
bytes AS (
  SELECT doc_id, (octet_length(encode(coalesce(text, ''))) + 16)::BIGINT AS size,
    list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'),
      lambda h: ('0x' || h)::UBIGINT) AS b
  FROM documents),
checked AS (
  SELECT doc_id, size,
    xor(list_reduce(list_prepend(4294967295::UBIGINT, b),
      lambda c, v: xor(c >> 8, crc_table[((xor(c, v) & 255) + 1)::BIGINT])), 4294967295::UBIGINT)::BIGINT AS text_crc32
  FROM bytes, bits),
domain AS (
  SELECT n, a, ((n + a - 1) // a)::BIGINT AS b, greatest({sharding.LEAST_BUCKETS}, n // {sharding.ROWS_PER_BUCKET})::BIGINT AS buckets
  FROM (SELECT n, greatest(1, ceil(sqrt(n)))::BIGINT AS a FROM (SELECT count(*)::BIGINT AS n FROM documents))),
numbered AS (
  SELECT doc_id, size, text_crc32, n,
    row_number() OVER (ORDER BY {_mix(f"(((coalesce(doc_id, 0) % {sharding.PRIME}) + {sharding.PRIME}) % {sharding.PRIME} + size % {sharding.PRIME} + text_crc32 % {sharding.PRIME})", sharding.KEYS[0])} % buckets,
      doc_id NULLS FIRST, size, text_crc32) - 1 AS row_number
  FROM checked, domain),
source AS (SELECT x, n, a, b FROM domain, range((SELECT a * b FROM domain)) t(x)),
once AS ({_step("x")}),
walked AS (
  SELECT x, y, n FROM once WHERE x < n
  UNION ALL
  SELECT walked.x, once.y, walked.n FROM walked JOIN once ON walked.y = once.x WHERE walked.y >= walked.n)
SELECT doc_id, size, text_crc32, 'rows' AS law, (y % 40)::INTEGER AS shard, (y // 40)::BIGINT AS slot,
  NULL::INTEGER AS grown_shard, row_number
FROM numbered JOIN walked ON walked.x = row_number AND walked.y < walked.n
"""


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _located(kind: str, pattern: str, group: int, least: int) -> str:
    p = _quoted(pattern)
    return f"""
      SELECT key, t, {secrets.ORDER[kind]} AS rank, '{kind}' AS kind, value,
        (list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda m: length(m))), 0))::BIGINT AS s,
        length(found[i]) AS long
      FROM (SELECT key, t, gaps, found, unnest(range(1, len(found) + 1)) AS i, unnest(regexp_extract_all(t, {p}, {group})) AS value
        FROM (SELECT key, t, string_split_regex(t, {p}) AS gaps, regexp_extract_all(t, {p}, 0) AS found
          FROM texts WHERE regexp_matches(t, {p})))
      WHERE length(value) >= {least}"""


# the limit of a stretch's class, null without letters
_LIMIT = f"""CASE
    WHEN regexp_matches(value, '[0-9]') AND regexp_full_match(value, '[0-9a-f]+|[0-9A-F]+') AND regexp_matches(value, '[A-Za-z]') THEN {secrets.LIMITS["hex"]}
    WHEN regexp_matches(value, '[0-9]') AND regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]') THEN {secrets.LIMITS["mixed"]}
    WHEN regexp_matches(value, '[0-9]') AND regexp_matches(value, '[a-z]') THEN {secrets.LIMITS["lower"]}
    WHEN regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Z]') THEN {secrets.LIMITS["upper"]}
    WHEN regexp_matches(value, '[A-Za-z]') THEN {secrets.LIMITS["letters"]} END"""

# what the base spans leave of a run is cut into pieces; a piece's windows are measured one by one here, without running counts
OP3_SQL = f"""
WITH texts AS MATERIALIZED (SELECT row_number() OVER () AS key, doc_id, coalesce(text, '') AS t FROM documents),
base AS MATERIALIZED (
  SELECT key, rank, kind, s, s + long AS e FROM (
    {" UNION ALL ".join(_located(kind, *rule) for kind, rule in secrets.KINDS.items())})),
runs AS MATERIALIZED (
  SELECT key, s AS run, s + long AS stop, value AS whole FROM ({_located("entropy", secrets.CANDIDATE, 0, 0)}) c
  WHERE NOT regexp_matches(value, {_quoted("(?i)" + secrets.IDENTIFIER)})),
cuts AS (
  SELECT runs.*, base.s AS until, base.e AS next, base.rank AS rank FROM runs JOIN base ON base.key = runs.key AND base.s < stop AND run < base.e
  UNION ALL
  SELECT runs.*, stop, stop, 99 FROM runs),
pieces AS (
  SELECT key, run, s, substr(whole, s - run + 1, until - s) AS value
  FROM (SELECT *, greatest(run, coalesce(max(next) OVER (PARTITION BY key, run ORDER BY until, rank, next ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), run)) AS s FROM cuts)
  WHERE until - s >= {secrets.WINDOW}),
windows AS (
  SELECT key, s, value, w, substr(value, w + 1, {secrets.WINDOW}) AS part
  FROM (SELECT *, unnest(range(0, length(value) - {secrets.WINDOW} + 1)) AS w FROM pieces)),
measured AS (
  SELECT key, s, w, any_value(value) AS value, -sum(n / {secrets.WINDOW}.0 * log2(n / {secrets.WINDOW}.0)) AS bits
  FROM (SELECT key, s, w, value, c, count(*) AS n FROM (SELECT *, unnest(string_split(part, '')) AS c FROM windows) GROUP BY ALL)
  GROUP BY key, s, w),
hot AS (
  SELECT key, s, any_value(value) AS value, min(w) AS first, max(w) AS last
  FROM measured WHERE bits >= ({_LIMIT}) - 1e-9 / {secrets.WINDOW} GROUP BY key, s),
scanned AS (
  SELECT key, {secrets.ORDER["entropy"]} AS rank, 'entropy' AS kind, s + first AS s, s + last + {secrets.WINDOW} AS e
  FROM hot WHERE NOT regexp_matches(substr(value, first + 1, last + {secrets.WINDOW} - first), {_quoted(secrets.ALLOWED)})),
every AS (SELECT * FROM base UNION ALL SELECT * FROM scanned),
per_text AS (
  SELECT key, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
    count(*) FILTER (kind = 'hex') AS n_hex, count(*) FILTER (kind = 'entropy') AS n_entropy,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (kind <> 'entropy') AS base_spans,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans
  FROM every GROUP BY key)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base_spans, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_entropy, 0) AS n_entropy
FROM texts LEFT JOIN per_text USING (key)
"""


OP5_SQL = """
WITH RECURSIVE
sound AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b
  ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.95),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
parts AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, component_id, vec_id = component_id AS kept
FROM parts
"""


def _spans(kind: str, pattern: str) -> str:
    p = _quoted(pattern)
    return f"""
      SELECT key, t, '{kind}' AS kind, value,
        (list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda m: length(m))), 0))::BIGINT AS s
      FROM (SELECT key, t, gaps, found, unnest(range(1, len(found) + 1)) AS i, unnest(found) AS value
        FROM (SELECT key, t, string_split_regex(t, {p}) AS gaps, regexp_extract_all(t, {p}, 0) AS found
          FROM texts WHERE regexp_matches(t, {p})))"""


_PII_SHAPES = {"email": personal_data.EMAIL, "ip": personal_data.IP, "card": personal_data.CARD, "phone": personal_data.PHONE, **personal_data.SHAPES}
_CODES = "regexp_replace(value, '[ -]', '', 'g')"
_FIGURES = "regexp_replace(value, '[^0-9]', '', 'g')"
_DIGIT = "list_transform(string_split(code, ''), lambda c: try_cast(c AS BIGINT))"


def _case(values: dict[str, int]) -> str:
    return "CASE kind " + " ".join(f"WHEN '{kind}' THEN {value}" for kind, value in values.items()) + " END"


def _hinted(words: dict[str, str]) -> str:
    return "CASE kind " + " ".join(f"WHEN '{kind}' THEN regexp_matches(before, '(?i){found}')" for kind, found in words.items()) + " END"


# checks per kind on `code`, the value without blanks and hyphens; phones keep their digits alone
_PII_CHECKS = f"""CASE kind
  WHEN 'email' THEN true
  WHEN 'ip' THEN len(list_filter(string_split(value, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(try_cast(ltrim(p, '0') AS BIGINT), 0) > 255)) = 0
  WHEN 'card' THEN length(code) BETWEEN 12 AND 19 AND list_sum(list_transform(string_split(reverse(code), ''),
    lambda c, i: CASE WHEN i % 2 = 1 THEN try_cast(c AS BIGINT) WHEN try_cast(c AS BIGINT) < 5 THEN 2 * try_cast(c AS BIGINT) ELSE 2 * try_cast(c AS BIGINT) - 9 END)) % 10 = 0
  WHEN 'phone' THEN length({_FIGURES}) BETWEEN 9 AND 15
  WHEN 'iban' THEN list_reduce(list_prepend(0::BIGINT, list_transform(string_split(code[5:] || code[:4], ''),
    lambda c: CASE WHEN c >= 'A' THEN ascii(c) - 55 ELSE ascii(c) - 48 END::BIGINT)), lambda r, d: (r * (CASE WHEN d > 9 THEN 100 ELSE 10 END) + d) % 97) = 1
  WHEN 'nir' THEN try_cast(code[14:] AS BIGINT) = 97 - try_cast(code[:13] AS BIGINT) % 97
  WHEN 'dni' THEN '{personal_data.DNI_LETTERS}'[try_cast(code[:8] AS BIGINT) % 23 + 1] = code[-1]
  WHEN 'steuer_id' THEN code[1] <> '0' AND (11 - list_reduce(list_prepend(10::BIGINT, {_DIGIT}[:10]),
    lambda m, d: (CASE WHEN (m + d) % 10 = 0 THEN 10 ELSE (m + d) % 10 END) * 2 % 11)) % 10 = try_cast(code[11] AS BIGINT)
  WHEN 'ssn' THEN code[:3] NOT IN ('000', '666') AND code[:3] < '900' AND code[4:5] <> '00' AND code[6:] <> '0000'
END"""

OP13_SQL = f"""
WITH texts AS MATERIALIZED (SELECT row_number() OVER () AS key, doc_id, coalesce(text, '') AS t FROM documents),
found AS MATERIALIZED ({" UNION ALL ".join(_spans(kind, shape) for kind, shape in _PII_SHAPES.items())}),
confirmed AS (
  SELECT key, kind, s, s + length(value) AS e, {_case(personal_data.ORDER)} AS rank,
    substr(t, greatest(s - {personal_data.NEAR}, 0) + 1, least(s, {personal_data.NEAR})) AS before
  FROM (SELECT *, {_CODES} AS code FROM found) WHERE {_PII_CHECKS}),
scored AS (
  SELECT *, least(greatest({_case({k: v + personal_data.CONFIRMED * (k in personal_data.CHECKED) for k, v in personal_data.PRIOR.items()})}
      + CASE WHEN {_hinted(personal_data.HINTS)} THEN {personal_data.CONTEXT} ELSE 0 END
      - CASE WHEN regexp_matches(before, '(?i){personal_data.CONTRARY}') THEN {personal_data.CONTEXT} ELSE 0 END, 0), 100) AS score
  FROM confirmed),
every AS (SELECT * FROM scored WHERE rank < {len(personal_data.BASE)} OR score >= {personal_data.LEAST}),
per_text AS (
  SELECT key, {", ".join(f"count(*) FILTER (kind = '{kind}') AS n_{kind}" for kind in personal_data.BASE)},
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (rank < {len(personal_data.BASE)}) AS base_spans,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans,
    count(*) FILTER (rank >= {len(personal_data.BASE)}) AS n_added, max(score)::INTEGER AS risk
  FROM every GROUP BY key)
SELECT doc_id, {", ".join(f"coalesce(n_{kind}, 0) AS n_{kind}" for kind in personal_data.BASE)},
  sha256(coalesce(base_spans, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_added, 0) AS n_added, coalesce(risk, 0) AS risk
FROM texts LEFT JOIN per_text USING (key)
"""


_LEVELS = 5  # sources of up to 16 ** 5 rows, as many sources


def _levels(start: str, name: str) -> str:
    """Nodes and runs of every level over `start` (tree, idx, d, cnt)."""
    out = [f"{name}0 AS MATERIALIZED (SELECT tree, idx, d, cnt FROM {start})"]
    for k in range(_LEVELS):
        out.append(
            f"{name}_run{k} AS MATERIALIZED (SELECT tree, idx // 16 AS idx, string_agg(d, '' ORDER BY idx) AS run, any_value(cnt) AS cnt FROM {name}{k} WHERE cnt > 1 GROUP BY tree, idx // 16)"
        )
        out.append(
            f"{name}{k + 1} AS MATERIALIZED (SELECT tree, idx, sha256(run) AS d, (cnt + 15) // 16 AS cnt FROM {name}_run{k} UNION ALL SELECT tree, idx, d, cnt FROM {name}{k} WHERE cnt = 1)"
        )
    return ",\n".join(out)


def _followed(source: str, name: str, levels: str) -> str:
    """`source` with proof and fold carried over the runs of all levels; idx is the place among the lowest nodes."""
    out, before = [], source
    for k in range(_LEVELS):
        place = f"((idx // {16**k}) % 16)::BIGINT"
        left, right = f"run[:64 * {place}]", f"run[64 * {place} + 65:]"
        out.append(
            f"""{name}{k} AS (SELECT s.* EXCLUDE (proof, fold), proof || coalesce({left} || {right}, '') AS proof,
  CASE WHEN run IS NULL THEN fold ELSE sha256({left} || fold || {right}) END AS fold
  FROM (SELECT b.*, r.run FROM {before} b LEFT JOIN {levels}_run{k} r ON r.tree = b.tree AND r.idx = b.idx // {16 ** (k + 1)}) s)"""
        )
        before = f"{name}{k}"
    return ",\n".join(x.replace("EXCLUDE (proof, fold)", "EXCLUDE (proof, fold, run)") for x in out)


def _field(value: str) -> str:
    return f"coalesce(octet_length(encode({value}::VARCHAR)) || ':' || {value}::VARCHAR, '-')"


_HEAD = " || ".join(map(_field, ("doc_id", "source", "lang", "n_chars")))

OP11_SQL = f"""
WITH RECURSIVE
bits AS (
  SELECT list(c ORDER BY i) AS crc_table FROM (
    SELECT i, list_reduce(list_prepend(i::UBIGINT, [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]),
      lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS c
    FROM range(256) t(i))),
chosen AS (
  SELECT *, doc_id IS NOT NULL AND xor(list_reduce(list_prepend(4294967295::UBIGINT,
      list_transform(regexp_extract_all(hex(encode(doc_id::VARCHAR)), '..'), lambda h: ('0x' || h)::UBIGINT)),
      lambda c, v: xor(c >> 8, crc_table[((xor(c, v) & 255) + 1)::BIGINT])), 4294967295::UBIGINT) % 5 = 0 AS tampered
  FROM documents, bits),
hashed AS MATERIALIZED (
  SELECT CASE WHEN source IS NULL THEN '' ELSE '+' || source END AS tree, doc_id, sha256({_HEAD} || {_field("text")}) AS d,
    CASE WHEN tampered THEN sha256({_HEAD} || {_field(f"translate(text, '{manifest.UPPER}', '{manifest.LOWER}')")}) END AS other
  FROM chosen),
leaves AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, d) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS cnt FROM hashed),
{_levels("leaves", "n")},
subroots AS MATERIALIZED (
  SELECT '' AS tree, tree AS own, d, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS cnt FROM n{_LEVELS}),
{_levels("subroots", "t")},
paths AS (SELECT doc_id, tree, idx, d AS leaf, '' AS proof, coalesce(other, d) AS fold FROM leaves),
{_followed("paths", "p", "n")},
tops AS (SELECT doc_id, leaf, subroots.d AS subroot, '' AS tree, subroots.idx AS idx, proof, fold
  FROM p{_LEVELS - 1} p JOIN subroots ON subroots.own = p.tree),
{_followed("tops", "q", "t")}
SELECT doc_id, leaf, subroot, (SELECT d FROM t{_LEVELS}) AS root, sha256(proof) AS proof_sha256, fold AS folded_root,
  fold = (SELECT d FROM t{_LEVELS}) AS verified
FROM q{_LEVELS - 1}
"""
