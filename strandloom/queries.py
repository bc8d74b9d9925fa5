"""Registered queries of the sampling operators over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions import bases, kernel, sql as sql_functions, wide
from strandloom.operators import analytics as A
from strandloom.operators import compare
from strandloom.operators import sketch as S
from strandloom.options import SketchOptions, syncmer_options
from strandloom.plans import relational as R
from strandloom.sources import sequences as Q


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sequences(spark: SparkSession, sf_dir: str, ambiguous: bool = False) -> DataFrame:
    """(id, seq): the DNA letters of documents."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return docs.select("id", bases.dna_letters(F.col("text"), ambiguous).alias("seq"))


# ---------------------------------------------------------------- SQL texts

def _seqs(letters: str = "ACGTacgt", source: str = "documents", key: str = "doc_id") -> str:
    return f"seqs AS (SELECT {key} AS id, regexp_replace(text, '[^{letters}]', '', 'g') AS s FROM {source})"


def _nt(c: str) -> str:
    """The hash constant of a base code."""
    return f"CASE {c} " + " ".join(f"WHEN {i} THEN {int(x)}" for i, x in enumerate(kernel.NT)) + " END"


def _turn(x: str, by: str) -> str:
    """x rotated left by `by`, a non-negative expression."""
    return f"((({x}) << CAST(({by}) % 32 AS BIGINT)) & 4294967295) | (({x}) >> CAST(32 - ({by}) % 32 AS BIGINT))"


def _bases() -> str:
    return """b AS (
  SELECT id, i - 1 AS pos, n, letter IN ('A','C','G','T','a','c','g','t') AS plain,
    CASE upper(letter) WHEN 'A' THEN 0 WHEN 'C' THEN 1 WHEN 'T' THEN 2 ELSE 3 END AS c
  FROM (SELECT id, i, n, substr(s, CAST(i AS INTEGER), 1) AS letter FROM (SELECT id, s, length(s) AS n, unnest(range(1, length(s) + 1)) AS i FROM seqs))
)"""


def _hash_sql(k: int, canonical: bool) -> str:
    nt, rc = _nt("c"), _nt("xor(c, 2)")
    # the k-mer's own offset j is pos - i, so each base is turned as often as its place asks
    frame = f"OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {k - 1} FOLLOWING)"
    fw = f"bit_xor(gf) {frame}"
    rv = f"bit_xor(gr) {frame}"
    text = f"""g AS (
  SELECT *, {_turn(nt, '(32 - (7 * pos) % 32)')} AS gf, {_turn(rc, '7 * pos')} AS gr FROM b
), x AS (SELECT *, {fw} AS xf, {rv} AS xr FROM g),
h AS (
  SELECT id, pos, n, c, plain, CASE WHEN pos + {k} <= n THEN {{}} END AS hash FROM x
)"""
    forward = f"({_turn('xf', f'7 * (pos + {k - 1})')})"
    both = f"(({forward} + ({_turn('xr', '(32 - (7 * pos) % 32)')})) & 4294967295)"
    return text.format(both if canonical else forward)


def _answers(o: SketchOptions) -> str:
    run = f"OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {o.w - 1} FOLLOWING)"
    span = f"OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {o.length - 1} FOLLOWING)"
    pick = "CAST(l & 4294967295 AS BIGINT)"
    if o.canonical:
        pick = f"CASE WHEN 2 * tg > {o.length} THEN {pick} ELSE CAST(4294967295 - (r & 4294967295) AS BIGINT) END"
    where = f"pos + {o.length} <= n" + (" AND allplain" if o.ambiguous == "skip" else "")
    return f"""m AS (
  SELECT *, min((hash >> 16) * 4294967296 + pos) {run} AS l, min((hash >> 16) * 4294967296 + (4294967295 - pos)) {run} AS r,
    CAST(sum(c >> 1) {span} AS BIGINT) AS tg, bool_and(plain) {span} AS allplain FROM h
), a AS (SELECT id, pos AS win, {pick} AS pos FROM m WHERE {where})"""


def _picked(o: SketchOptions) -> str:
    if o.kind == "closed":
        return f"p AS (SELECT * FROM a WHERE pos = win OR pos = win + {o.w - 1})"
    if o.kind == "open":
        return f"p AS (SELECT * FROM a WHERE pos = win + {o.w // 2})"
    if o.all_windows:
        return "p AS (SELECT * FROM a)"
    return "p AS (SELECT id, win, pos FROM (SELECT *, lag(pos) OVER (PARTITION BY id ORDER BY win) AS q FROM a) WHERE q IS NULL OR q <> pos)"


def _with(o: SketchOptions, seqs: str | None = None) -> str:
    letters = "ACGTNacgtn" if o.ambiguous == "skip" else "ACGTacgt"
    return "WITH " + ",\n".join([seqs or _seqs(letters), _bases(), _hash_sql(o.k, o.hash_canonical), _answers(o), _picked(o)])


def sample_sql(o: SketchOptions) -> str:
    return _with(o) + "\nSELECT id, win, pos FROM p"


def value_sql(o: SketchOptions, seqs: str | None = None, select: str = "SELECT id, win, pos, value FROM v") -> str:
    n = o.value_length
    at = "p.pos" if o.kind == "minimizers" else "p.win"
    kind = "BIGINT" if n <= 31 else "HUGEINT"
    low = f"CAST(sum(CAST(b.c AS {kind}) * CAST(pow(2, 2 * (b.pos - {at})) AS {kind})) AS {kind})"
    rev = f"CAST(sum(CAST(xor(b.c, 2) AS {kind}) * CAST(pow(2, 2 * ({n - 1} - (b.pos - {at}))) AS {kind})) AS {kind})"
    value = f"least({low}, {rev})" if o.canonical else low
    return _with(o, seqs) + f""",
v AS (
  SELECT p.id, p.win, p.pos, {value} AS value FROM p JOIN b ON b.id = p.id AND b.pos >= {at} AND b.pos < {at} + {n} GROUP BY p.id, p.win, p.pos
)
{select}"""


def rolling_sql(constant: str, k: int, w: int, source: str) -> str:
    """Forward minimizers for a hasher that turns one constant per symbol."""
    frame = f"OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {k - 1} FOLLOWING)"
    o = SketchOptions(k, w)
    return f"""WITH {source},
g AS (SELECT *, {_turn(constant, '(32 - (7 * pos) % 32)')} AS gf FROM b), x AS (SELECT *, bit_xor(gf) {frame} AS xf FROM g),
h AS (SELECT id, pos, n, c, true AS plain, CASE WHEN pos + {k} <= n THEN ({_turn('xf', f'7 * (pos + {k - 1})')}) END AS hash FROM x),
{_answers(o)}, {_picked(o)}
SELECT id, win, pos FROM p"""


# ---------------------------------------------------------------- queries

F5, C5 = SketchOptions(5, 7), SketchOptions(5, 7, canonical=True)
F21, C21 = SketchOptions(21, 11), SketchOptions(21, 11, canonical=True)
QUERIES: dict = {}
SQL: dict = {}


def _add(name: str, query, text: str | None = None) -> None:
    QUERIES[name] = query
    if text:
        SQL[name] = text


def _samples(o: SketchOptions, **more):
    return lambda spark, d: S.sketch(sequences(spark, d, o.ambiguous == "skip"), "seq", o, **more)


for _name, _o in {
    "minimizers": F21, "canonical_minimizers": C21, "minimizers_k5_w7": F5, "canonical_minimizers_k5_w7": C5,
    "windows": SketchOptions(5, 7, all_windows=True), "canonical_windows": SketchOptions(5, 7, canonical=True, all_windows=True),
    "closed_syncmers": SketchOptions(11, 11, kind="closed"), "canonical_closed_syncmers": SketchOptions(11, 11, canonical=True, kind="closed"),
    "open_syncmers": SketchOptions(11, 11, kind="open"), "canonical_open_syncmers": SketchOptions(11, 11, canonical=True, kind="open"),
    "syncmers_by_s": syncmer_options(7, 15), "forward_with_canonical_hash": SketchOptions(31, 5, symmetric=True),
    "minimizers_w19": SketchOptions(19, 19), "minimizers_k33": SketchOptions(33, 5), "minimizers_k1_w1": SketchOptions(1, 1),
    "skip_ambiguous_minimizers": SketchOptions(5, 7, canonical=True, ambiguous="skip"),
    "skip_ambiguous_forward": SketchOptions(5, 7, ambiguous="skip"),
    "skip_ambiguous_closed_syncmers": SketchOptions(5, 7, canonical=True, kind="closed", ambiguous="skip"),
    "skip_ambiguous_open_syncmers": SketchOptions(5, 7, canonical=True, kind="open", ambiguous="skip"),
}.items():
    _add(_name, _samples(_o), sample_sql(_o))

for _name, _o in {"minimizers": F21, "canonical_minimizers": C21, "canonical_open_syncmers": SketchOptions(11, 11, canonical=True, kind="open")}.items():
    _add(f"relational_{_name}", lambda spark, d, o=_o: R.sketch(sequences(spark, d), "seq", o, ["id"]), sample_sql(_o))
    _add(f"chunked_{_name}", _samples(_o, chunk=100), sample_sql(_o))
_add("spread_minimizers", _samples(F21, chunk=1000, spread=16), sample_sql(F21))

for _name, _o in {
    "minimizer_values": F21, "canonical_minimizer_values": C21, "closed_syncmer_values": SketchOptions(11, 11, kind="closed"),
    "canonical_closed_syncmer_values": SketchOptions(11, 11, canonical=True, kind="closed"),
    "open_syncmer_values": SketchOptions(11, 11, kind="open"), "canonical_open_syncmer_values": SketchOptions(11, 11, canonical=True, kind="open"),
}.items():
    _add(_name, _samples(_o, value=True), value_sql(_o))

# values beyond 64 bits, as text
for _name, _o in {"wide_minimizer_values": SketchOptions(33, 5), "wide_canonical_syncmer_values": SketchOptions(21, 25, canonical=True, kind="closed")}.items():
    _add(
        _name, lambda spark, d, o=_o: S.sketch(sequences(spark, d), "seq", o, value=True).withColumn("value", F.col("value").cast("string")),
        value_sql(_o, select="SELECT id, win, pos, CAST(value AS VARCHAR) AS value FROM v"),
    )

for _name, _canonical in {"kmer_hashes": False, "canonical_kmer_hashes": True}.items():
    _o = SketchOptions(21, 1, symmetric=_canonical)
    _add(
        _name, lambda spark, d, o=_o: S.kmer_hashes(sequences(spark, d), "seq", o),
        f"WITH {_seqs()},\n{_bases()},\n{_hash_sql(21, _canonical)}\nSELECT id, pos, CAST(hash AS BIGINT) AS hash FROM h WHERE hash IS NOT NULL",
    )

for _name, _o in {"super_kmers": F21, "canonical_super_kmers": C21}.items():
    _add(
        _name, lambda spark, d, o=_o: S.super_kmers(sequences(spark, d), "seq", o),
        _with(_o) + f""", e AS (SELECT p.*, lead(win) OVER (PARTITION BY p.id ORDER BY win) AS nxt, length(seqs.s) - {_o.length} + 1 AS lst FROM p JOIN seqs ON seqs.id = p.id)
SELECT id, win, pos, CAST(coalesce(nxt, lst) AS BIGINT) AS end_win, CAST(coalesce(nxt, lst) - win + {_o.length - 1} AS BIGINT) AS length FROM e""",
    )

_add(
    "one_minimizer", lambda spark, d: S.one_minimizer(sequences(spark, d), "seq", 21),
    f"WITH {_seqs()},\n{_bases()},\n{_hash_sql(21, False)}\n"
    "SELECT seqs.id, CAST(min((hash >> 16) * 4294967296 + pos) & 4294967295 AS BIGINT) AS pos FROM seqs LEFT JOIN h ON h.id = seqs.id GROUP BY seqs.id",
)
_add(
    "positions_array", lambda spark, d: sequences(spark, d).select("id", S.positions(F.col("seq"), C21).alias("positions")).select("id", F.size("positions").cast("long").alias("n"), F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions")),
    _with(C21) + "\nSELECT seqs.id, count(pos)::BIGINT AS n, coalesce(string_agg(pos::VARCHAR, ',' ORDER BY win), '') AS positions FROM seqs LEFT JOIN p ON p.id = seqs.id GROUP BY seqs.id",
)


def _sql_surface(spark: SparkSession, d: str) -> DataFrame:
    sql_functions.register(spark)
    rows = sequences(spark, d).selectExpr("id", "minimizer_positions(seq, 21, 11) AS p", "canonical_minimizer_positions(seq, 21, 11) AS q")
    return rows.select("id", F.size("p").cast("long").alias("forward"), F.size("q").cast("long").alias("canonical"))


def _counted(o: SketchOptions, name: str) -> str:
    return f"(SELECT count(*) FROM ({_with(o)} SELECT id FROM p) z WHERE z.id = d.doc_id) AS {name}"


_add("sql_functions", _sql_surface, (
    f"WITH f AS (SELECT id, count(*) AS n FROM ({_with(F21)} SELECT id FROM p) GROUP BY id), c AS (SELECT id, count(*) AS n FROM ({_with(C21)} SELECT id FROM p) GROUP BY id) "
    "SELECT doc_id AS id, coalesce(f.n, 0)::BIGINT AS forward, coalesce(c.n, 0)::BIGINT AS canonical FROM documents LEFT JOIN f ON f.id = doc_id LEFT JOIN c ON c.id = doc_id"
))

# bases and sequences
_add(
    "base_codes", lambda spark, d: R.bases(sequences(spark, d, True), "seq", ["id"]).select("id", "pos", F.col("code").cast("long").alias("code"), bases.complement_code(F.col("code")).cast("long").alias("complement"), bases.base_letter(F.col("code")).alias("letter"), "plain"),
    f"WITH {_seqs('ACGTNacgtn')}, {_bases()} SELECT id, pos, c::BIGINT AS code, xor(c, 2)::BIGINT AS complement, substr('ACTG', c + 1, 1) AS letter, plain FROM b",
)
_add(
    "reverse_complement", lambda spark, d: sequences(spark, d).select("id", bases.reverse_complement(F.col("seq")).alias("seq")),
    f"WITH {_seqs()} SELECT id, reverse(translate(s, 'ACGTacgt', 'TGCAtgca')) AS seq FROM seqs",
)
_add(
    "revcomp_minimizers", lambda spark, d: S.sketch(sequences(spark, d).select("id", bases.reverse_complement(F.col("seq")).alias("seq")), "seq", C21),
    _with(C21, _seqs().replace("seqs AS", "raw AS") + ", seqs AS (SELECT id, reverse(translate(s, 'ACGTacgt', 'TGCAtgca')) AS s FROM raw)") + "\nSELECT id, win, pos FROM p",
)
_add(
    "pack_bases", lambda spark, d: sequences(spark, d).select("id", F.lower(F.hex(bases.pack_bases(F.col("seq")))).alias("packed"), bases.unpack_bases(bases.pack_bases(F.col("seq")), F.length("seq")).alias("unpacked")),
    f"""WITH {_seqs()}, {_bases()}, q AS (SELECT id, pos // 4 AS quad, sum(c << CAST(2 * (pos % 4) AS BIGINT)) AS v FROM b GROUP BY 1, 2),
r AS (SELECT id, string_agg(lower(printf('%02x', v::INTEGER)), '' ORDER BY quad) AS packed FROM q GROUP BY id)
SELECT seqs.id, coalesce(packed, '') AS packed, upper(s) AS unpacked FROM seqs LEFT JOIN r ON r.id = seqs.id""",
)
_LCG = "SELECT i AS pos, substr('ACGT', CAST((((i * 1103515245 + 12345) % 4294967296) >> 16) % 4 AS INTEGER) + 1, 1) AS letter FROM range((SELECT 10 * count(*) FROM documents)) t(i)"
_length = lambda spark, d: 10 * table(spark, d, "documents").count()
_add("lcg_bases", lambda spark, d: Q.lcg_bases(spark, _length(spark, d)), _LCG)
_LCGS = f"seqs AS (SELECT 0::BIGINT AS id, string_agg(letter, '' ORDER BY pos) AS s FROM ({_LCG}))"
_add("lcg_minimizers", lambda spark, d: S.sketch(Q.lcg_sequence(spark, _length(spark, d)), "seq", SketchOptions(11, 11)), _with(SketchOptions(11, 11), _LCGS) + "\nSELECT id, win, pos FROM p")
_add(
    "from_codes", lambda spark, d: Q.from_codes(table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("id"), F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: F.call_function("shiftright", F.col("c_custkey").cast("long"), i).bitwiseAND(F.lit(3)).cast("int")).alias("codes")), "codes").select("id", "seq"),
    "SELECT c_custkey::BIGINT AS id, array_to_string(list_transform(range(0, 20), lambda i: substr('ACTG', CAST((c_custkey::BIGINT >> i) & 3 AS INTEGER) + 1, 1)), '') AS seq FROM customer",
)

# sliding minima and adjacent repeats
_HASHED = SketchOptions(21, 1)
_RUN = "OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 10 FOLLOWING)"
_add(
    "sliding_minimum", lambda spark, d: R.sliding_minimum(S.kmer_hashes(sequences(spark, d), "seq", _HASHED), ["id"], "pos", "hash", 11).select("id", "win", "left", "right"),
    f"""WITH {_seqs()},
{_bases()},
{_hash_sql(21, False)},
k AS (SELECT id, pos AS win, count(hash) {_RUN} AS many, min((hash >> 16) * 4294967296 + pos) {_RUN} AS l, min((hash >> 16) * 4294967296 + (4294967295 - pos)) {_RUN} AS r FROM h)
SELECT id, win, CAST(l & 4294967295 AS BIGINT) AS "left", CAST(4294967295 - (r & 4294967295) AS BIGINT) AS "right" FROM k WHERE many = 11""",
)
_add(
    "adjacent_distinct", lambda spark, d: R.adjacent_distinct(table(spark, d, "events").select("user_id", "event_id", F.col("event_type").alias("kind")), ["user_id"], "event_id", "kind"),
    "SELECT user_id, event_id, kind FROM (SELECT *, lag(kind) OVER (PARTITION BY user_id ORDER BY event_id) AS q FROM (SELECT user_id, event_id, event_type AS kind FROM events WHERE event_type IS NOT NULL)) WHERE q IS NULL OR q <> kind",
)

# other hashers, general text
_MULC = "((c + 1) * 2654435761) & 4294967295"
_add("mul_hasher", _samples(SketchOptions(21, 11, hasher="mul")), rolling_sql(_MULC, 21, 11, f"{_seqs()}, {_bases()}"))
_add(
    "text_minimizers", lambda spark, d: S.sketch(table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text"), "text", SketchOptions(9, 8, hasher="mul", alphabet="bytes"), keep=["id"]),
    rolling_sql(_MULC, 9, 8, """hexed AS (SELECT item_id AS id, hex(encode(text)) AS x FROM benchmark),
b AS (SELECT id, i AS pos, n, CAST('0x' || substr(x, CAST(2 * i + 1 AS INTEGER), 2) AS BIGINT) AS c FROM (SELECT id, x, length(x) // 2 AS n, unnest(range(0, length(x) // 2)) AS i FROM hexed))"""),
)
_SEEDED = SketchOptions(21, 11, hasher="mul", seed=1)
_add("seeded_hasher", _samples(_SEEDED), rolling_sql(f"xor({_MULC}, {(1 * 0x85EBCA6B + 0xC2B2AE35) & 0xFFFFFFFF})", 21, 11, f"{_seqs()}, {_bases()}"))
_ANTI = "CAST(sum((CASE WHEN q.pos = b.pos THEN 3 - q.c ELSE q.c END) << CAST(2 * (15 - (q.pos - b.pos)) AS BIGINT)) AS BIGINT)"
_add(
    "antilex_hasher", lambda spark, d: S.sketch(sequences(spark, d), "seq", SketchOptions(21, 11, hasher="antilex")),
    f"""WITH {_seqs()}, {_bases()},
h AS (SELECT b.id, b.pos, b.n, b.c, true AS plain, CASE WHEN b.pos + 21 <= b.n THEN {_ANTI} END AS hash
  FROM b JOIN b q ON q.id = b.id AND q.pos >= b.pos AND q.pos < b.pos + 16 GROUP BY b.id, b.pos, b.n, b.c),
{_answers(F21)}, {_picked(F21)} SELECT id, win, pos FROM p""",
)

# aggregations
_add(
    "samples_per_sequence", lambda spark, d: A.per_sequence(S.sketch(sequences(spark, d), "seq", F21), "id"), _with(F21) + "\nSELECT id, count(*)::BIGINT AS n FROM p GROUP BY id",
)
_add(
    "count_spread", lambda spark, d: A.spread(S.sketch(sequences(spark, d), "seq", F21), sequences(spark, d), "id").select("sequences", F.round("mean", 6).alias("mean"), F.round("stddev", 6).alias("stddev")),
    _with(F21) + ", n AS (SELECT seqs.id, count(p.win) AS n FROM seqs LEFT JOIN p ON p.id = seqs.id GROUP BY seqs.id)\nSELECT count(*)::BIGINT AS sequences, round(avg(n), 6) AS mean, round(stddev_pop(n), 6) AS stddev FROM n",
)
_add(
    "density", lambda spark, d: A.density(S.sketch(sequences(spark, d), "seq", C21), sequences(spark, d), "seq").select("positions", "bases", F.round("density", 9).alias("density")),
    _with(C21) + ", t AS (SELECT sum(length(s))::BIGINT AS bases FROM seqs), c AS (SELECT count(*)::BIGINT AS positions FROM p)\nSELECT positions, bases, round(positions / bases, 9) AS density FROM c, t",
)
_add(
    "syncmer_ends", lambda spark, d: A.ends(S.sketch(sequences(spark, d), "seq", SketchOptions(11, 11, kind="closed")), 11),
    _with(SketchOptions(11, 11, kind="closed")) + "\nSELECT count(*) FILTER (pos = win)::BIGINT AS prefix, count(*) FILTER (pos = win + 10)::BIGINT AS suffix, count(*)::BIGINT AS \"all\" FROM p",
)
_add(
    "syncmer_minimizer_ratio", lambda spark, d: A.ratio(S.sketch(sequences(spark, d), "seq", SketchOptions(11, 11, kind="closed")), S.sketch(sequences(spark, d), "seq", SketchOptions(11, 11))).select("a", "b", F.round("ratio", 9).alias("ratio")),
    f"WITH x AS (SELECT count(*)::BIGINT AS a FROM ({_with(SketchOptions(11, 11, kind='closed'))} SELECT id FROM p)), y AS (SELECT count(*)::BIGINT AS b FROM ({_with(SketchOptions(11, 11))} SELECT id FROM p)) SELECT a, b, round(a / b, 9) AS ratio FROM x, y",
)
_add(
    "value_sum", lambda spark, d: A.value_sum(S.sketch(sequences(spark, d), "seq", C21, value=True)).select(F.col("total").cast("string").alias("total")),
    value_sql(C21, select="SELECT sum(value)::VARCHAR AS total FROM v"),
)
_V11 = SketchOptions(11, 5, canonical=True)


def _shared(spark: SparkSession, d: str) -> DataFrame:
    left = S.sketch(sequences(spark, d), "seq", _V11, value=True)
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("item"), bases.dna_letters(F.col("text")).alias("seq"))
    return A.shared_values(left, S.sketch(items, "seq", _V11, value=True), "id", "item")


_add("shared_values", _shared, (
    f"WITH x AS ({value_sql(_V11, select='SELECT DISTINCT id, value FROM v')}), y AS ({value_sql(_V11, _seqs(source='benchmark', key='item_id'), 'SELECT DISTINCT id AS item, value FROM v')}) "
    "SELECT id, item, count(*)::BIGINT AS shared FROM x JOIN y USING (value) GROUP BY id, item"
))
_add(
    "median_table", lambda spark, d: A.median_table(table(spark, d, "events"), ["user_id"], "event_type", "value", ["click", "view", "purchase"]).select(F.col("user_id"), *[F.round(c, 6).alias(c) for c in ("click", "view", "purchase")]),
    "SELECT user_id, " + ", ".join(f"round(median(value) FILTER (event_type = '{c}'), 6) AS {c}" for c in ("click", "view", "purchase")) + " FROM events GROUP BY user_id",
)
_add(
    "extremes", lambda spark, d: A.extremes(table(spark, d, "events"), ["event_type"], "value").select("event_type", F.round("mean", 6).alias("mean"), "least", "most"),
    "SELECT event_type, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most FROM events GROUP BY event_type",
)
_add(
    "name_flags", lambda spark, d: table(spark, d, "part").select("p_partkey", F.col("p_name").contains("re").alias("flag"), F.replace(F.col("p_name"), F.lit("re"), F.lit("")).alias("name")),
    "SELECT p_partkey, contains(p_name, 're') AS flag, replace(p_name, 're', '') AS name FROM part",
)


# comparison samplers: 64-bit hashes, rightmost ties, jumping
def _upper(spark: SparkSession, d: str) -> DataFrame:
    return sequences(spark, d).select("id", F.upper("seq").alias("seq"))


_ALL64 = f"{(1 << 64) - 1}::UBIGINT"


def _turn64(x: str, by: str) -> str:
    """x rotated left in 64 bits by `by`, a non-negative expression."""
    r = f"CAST(({by}) % 64 AS UBIGINT)"
    return f"((({x}) & ({_ALL64} >> {r})) << {r}) | (({x}) >> (64::UBIGINT - {r}))"


def wide_sql(k: int, w: int, ties: str = "left", tail: str = "") -> str:
    """Answers of all windows, `a` (id, win, pos, lst), under the 64-bit hash with rotation 1."""
    letter = "CASE c " + " ".join(f"WHEN {i} THEN {wide.LETTERS[x]}::UBIGINT" for i, x in enumerate("ACTG")) + " END"
    frame = f"OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {k - 1} FOLLOWING)"
    run = f"OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {w - 1} FOLLOWING)"
    place = "pos" if ties == "left" else "-pos"
    return f"""WITH RECURSIVE {_seqs()}, {_bases()},
g AS (SELECT id, pos, n, {_turn64(letter, '(64 - pos % 64)')} AS t FROM b),
x AS (SELECT id, pos, n, bit_xor(t) {frame} AS t FROM g),
h AS (SELECT id, pos, n, {_turn64('t', f'pos + {k - 1}')} AS hash FROM x WHERE pos + {k} <= n),
a AS (SELECT id, pos AS win, abs(best.p)::BIGINT AS pos, (n - {k + w - 1})::BIGINT AS lst FROM (SELECT *, min({{'h': hash, 'p': {place}}}) {run} AS best FROM h) WHERE pos + {k + w - 1} <= n){tail}"""


_DISTINCT = "\nSELECT id, win, pos FROM (SELECT *, lag(pos) OVER (PARTITION BY id ORDER BY win) AS q FROM a) WHERE q IS NULL OR q <> pos"
_JUMPS = """,
j AS (SELECT * FROM a WHERE win = 0 AND lst > 0 UNION ALL SELECT a.* FROM j JOIN a ON a.id = j.id AND a.win = j.pos + 1 WHERE a.win < a.lst),
e AS (SELECT id, max(pos) AS pos FROM j GROUP BY id)
SELECT id, win, pos FROM j UNION ALL SELECT a.id, a.win, a.pos FROM a LEFT JOIN e ON e.id = a.id WHERE a.win = a.lst AND (e.pos IS NULL OR e.pos <> a.pos)"""
_add("wide_minimizers", lambda spark, d: compare.wide_minimizers(_upper(spark, d), "seq", 21, 11), wide_sql(21, 11) + _DISTINCT)
_add("rightmost_minimizers", lambda spark, d: compare.wide_minimizers(_upper(spark, d), "seq", 3, 11, ties="right"), wide_sql(3, 11, "right") + _DISTINCT)
_add("jumping_minimizers", lambda spark, d: compare.wide_minimizers(_upper(spark, d), "seq", 21, 11, scheme="jumping"), wide_sql(21, 11, tail=_JUMPS))


def _stream(spark: SparkSession, d: str) -> DataFrame:
    """Canonical minimizers of a file stream of conversations, run to its end."""
    from strandloom.streaming.stream import run_to_end, sketch_stream

    source = spark.read.parquet(f"{d}/conversations.parquet")
    stream = spark.readStream.schema(source.schema).parquet(f"{d}/conversations.parquet*")
    rows = stream.select("conv_id", "turn", bases.dna_letters(F.col("text")).alias("seq"))
    return run_to_end(sketch_stream(rows, "seq", C5))


_add("stream_minimizers", _stream, (
    _with(C5, "seqs AS (SELECT conv_id * 1000000 + turn AS id, regexp_replace(text, '[^ACGTacgt]', '', 'g') AS s FROM conversations)")
    + "\nSELECT (id // 1000000)::BIGINT AS conv_id, (id % 1000000)::BIGINT AS turn, win, pos FROM p"
))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical minimizers of the documents."""
    return QUERIES["canonical_minimizers"](spark, sf_dir)
