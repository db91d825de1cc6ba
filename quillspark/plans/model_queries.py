"""Queries of layers, optimiser steps, nested documents and what is kept between runs, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import vectors as V
from quillspark.operators import groups, linear_maps, nested, recurrences, splits
from quillspark.plans.queries import CLEAN, RATIOS, cleaned, query, r, rounded
from quillspark.plans.tables import M, manifest, read
from quillspark.scratch import Scratch
from quillspark.sources import records, sinks, states


def _weights(rows: int, columns: int, seed: int) -> list[list[float]]:
    """Fixed weights by a rule that both engines can state: ((7 * row + 3 * column + seed) mod 11 - 5) / 10."""
    return [[((7 * i + 3 * j + seed) % 11 - 5) / 10 for j in range(columns)] for i in range(rows)]


def _sql_weights(rows: int, columns: int, seed: int) -> str:
    return "[" + ", ".join("[" + ", ".join(f"{x}::DOUBLE" for x in row) + "]" for row in _weights(rows, columns, seed)) + "]"


def _dot(a: str, b: str, n: int) -> str:
    return f"list_sum(list_transform(range(1, {n + 1}), lambda i: ({a})[i] * ({b})[i]))"


def _matvec(matrix: str, x: str, n: int) -> str:
    return f"list_transform({matrix}, lambda row: list_sum(list_transform(range(1, {n + 1}), lambda i: row[i] * {x}[i])))"


CHANNELS, HIDDEN, CLASSES = 16, 8, 5
HEADS = 2 * CLASSES - 1
L8_SQL = f"""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings),
p AS (SELECT vec_id, list_transform(range(0, {CHANNELS}), lambda c: list_sum(x[c * 4 + 1 : c * 4 + 4]) / 4) AS x FROM e),
h AS (SELECT vec_id, list_transform({_matvec(_sql_weights(HIDDEN, CHANNELS, 1), 'x', CHANNELS)}, lambda v: greatest(0::DOUBLE, v + 0.05)) AS h FROM p),
o AS (SELECT vec_id, {_matvec(_sql_weights(HEADS, HIDDEN, 2), 'h', HIDDEN)} AS o FROM h)
SELECT vec_id, unit::INT AS unit, round(o[unit + 1], 6) AS value FROM o, range(0, {HEADS}) t(unit)"""


@query("L8", L8_SQL)
def l8(spark, d):
    """Pooling, a shared layer and both heads: units 0-4 are the classes' logits, 5-8 the thresholds'."""
    e = read(spark, d, "embeddings").select("vec_id", V.pooled(F.col("embedding").cast("array<double>"), CHANNELS).alias("x"))
    hidden = linear_maps.linear(e, "vec_id", "x", linear_maps.weight_blocks(spark, _weights(HIDDEN, CHANNELS, 1), [0.05] * HIDDEN))
    each = F.array(*(F.greatest(F.lit(0.0), F.max(F.when(F.col("unit") == k, F.col("value")))) for k in range(HIDDEN)))
    out = linear_maps.linear(hidden.groupBy("vec_id").agg(each.alias("h")), "vec_id", "h", linear_maps.weight_blocks(spark, _weights(HEADS, HIDDEN, 2)))
    return rounded(out)


@query("L8_fitted")
def l8_fitted(spark, d):
    """Logits of both heads fitted on all labelled rows; without SQL, as it has no solver."""
    e = read(spark, d, "embeddings").select("vec_id", V.pooled(F.col("embedding").cast("array<double>"), CHANNELS).alias("x"), (F.col("label") % CLASSES).cast("int").alias("label"))
    weights, bias = linear_maps.fitted_heads(e, "x", "label", CHANNELS, CLASSES)
    return linear_maps.head_logits(e, "vec_id", "x", linear_maps.weight_blocks(spark, weights.tolist(), bias.tolist()), CLASSES)


L10_SQL = """WITH RECURSIVE n AS (SELECT event_type, value - 20 AS g, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS place FROM events WHERE value IS NOT NULL),
acc AS (SELECT event_type, place // 4 AS step, avg(g) AS g FROM n GROUP BY ALL),
norms AS (SELECT step, sqrt(sum(g * g)) AS norm FROM acc GROUP BY step),
c AS MATERIALIZED (SELECT event_type, step, g * least(1::DOUBLE, 1 / (norm + 1e-6::DOUBLE)) AS g, 0.1::DOUBLE * 0.5::DOUBLE * (1 + cos(3.141592653589793::DOUBLE * (step % 50) / 50)) AS rate FROM acc JOIN norms USING (step)),
s AS (
  SELECT event_type, -1::BIGINT AS step, 0::DOUBLE AS g, 0::DOUBLE AS m, 0::DOUBLE AS v, 0::DOUBLE AS value FROM (SELECT DISTINCT event_type FROM c)
  UNION ALL
  SELECT s.event_type, c.step, c.g, 0.9::DOUBLE * s.m + 0.1::DOUBLE * c.g, 0.999::DOUBLE * s.v + 0.001::DOUBLE * c.g * c.g,
    s.value * (1 - c.rate * 0.01::DOUBLE) - c.rate * ((0.9::DOUBLE * s.m + 0.1::DOUBLE * c.g) / (1 - pow(0.9::DOUBLE, c.step + 1)))
      / (sqrt((0.999::DOUBLE * s.v + 0.001::DOUBLE * c.g * c.g) / (1 - pow(0.999::DOUBLE, c.step + 1))) + 1e-8::DOUBLE)
  FROM s JOIN c ON c.event_type = s.event_type AND c.step = s.step + 1
) SELECT event_type, step, round(g, 6) AS gradient, round(m, 6) AS m, round(v, 6) AS v, round(value, 6) AS value FROM s WHERE step >= 0"""


@query("L10_steps", L10_SQL)
def l10_steps(spark, d):
    """Each event type as a parameter whose gradients are its events in order: accumulation, clipping, AdamW under a cosine rate."""
    e = read(spark, d, "events").select("event_type", "ts", "event_id", (F.col("value") - 20).alias("g"))
    return rounded(recurrences.trained(e, "event_type", ["ts", "event_id"], "g"))


DOCUMENT = """'{"Meta":{"type":"' || event_type || '","raw":' || props || '},"items":[' || props || ',{"User":{"id":' || CAST(user_id AS VARCHAR) || ',"tags":["a","b",[]]}}],"none":null}'"""


def _documents(spark, d):
    """Events as nested documents around their props."""
    e = read(spark, d, "events")
    return e.select("event_id", F.expr(DOCUMENT.replace("VARCHAR", "STRING")).alias("doc"))


@query("F7_leaves", f"WITH e AS (SELECT event_id, {DOCUMENT} AS doc FROM events) SELECT event_id, replace(fullkey, '\"', '') AS path, CASE WHEN j.type = 'ARRAY' THEN '[]' ELSE j.atom ->> '$' END AS value FROM e, json_tree(e.doc) j WHERE j.type NOT IN ('OBJECT', 'ARRAY') OR CAST(j.value AS VARCHAR) = '[]'")
def f7_leaves(spark, d):
    """Every leaf of each event's document at any depth."""
    return nested.flattened(_documents(spark, d), "event_id", "doc")


@query("X11", f"WITH e AS (SELECT event_id, {DOCUMENT} AS doc FROM events) SELECT event_id, replace(fullkey, '\"', '') AS path FROM e, json_tree(e.doc) j WHERE lower(j.key) IN ('k', 'user', 'cutout')")
def x11(spark, d):
    """Where forbidden names stand in each event's document."""
    return nested.forbidden_names(_documents(spark, d), "event_id", "doc", ["K", "USER", "CutOut"])


#: Settings of a report, some of which an event changes: both engines read them from the same text.
SETTINGS = """concat('{"report":{"only":', CAST(event_id % 3 <> 0 AS STRING), ',"steps":[', props, ']},"files":{"delete":', CASE WHEN event_id % 5 = 0 THEN 'true' WHEN event_id % 7 = 0 THEN 'null' ELSE 'false' END, '}}')"""
FIXED = {"$.report.only": "true", "$.files.delete": "false"}


@query("P9", f"WITH e AS (SELECT event_id, {SETTINGS} AS doc FROM events) " + " UNION ALL ".join(f"SELECT event_id, '{p}' AS path, doc ->> '{p}' AS value FROM e WHERE doc ->> '{p}' IS DISTINCT FROM '{v}'" for p, v in FIXED.items()))
def p9(spark, d):
    """Where an event's settings change what must stay: reports only report, and nothing is deleted."""
    return nested.changed_settings(read(spark, d, "events").select("event_id", F.expr(SETTINGS).alias("doc")), "event_id", "doc", FIXED)


def _uniform(text: str, place: str) -> str:
    return f"((('0x' || substr(sha256({text} || ':' || ({place})::VARCHAR), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE)"


def _embedding_sql(n: int, seed: int) -> str:
    digest = f"sha256('{seed}:' || coalesce(text, ''))"
    even, odd = _uniform("h", "2 * (i // 2)"), _uniform("h", "2 * (i // 2) + 1")
    turn = f"2 * pi() * {odd}"
    return f"""SELECT doc_id, lang, source, list_transform(z, lambda x: x / sqrt(list_sum(list_transform(z, lambda y: y * y)))) AS x FROM (
  SELECT doc_id, lang, source, list_transform(range(0, {n}), lambda i: sqrt(-2 * ln({even})) * CASE WHEN i % 2 = 0 THEN cos({turn}) ELSE sin({turn}) END) AS z
  FROM (SELECT doc_id, lang, source, {digest} AS h FROM documents))"""


PLACES = 16


@query("L5", f"WITH t AS ({_embedding_sql(PLACES, 0)}) SELECT doc_id, i::INT AS place, round(x[i + 1], 6) AS value FROM t, range(0, {PLACES}) r(i)")
def l5(spark, d):
    """A unit vector for each document, decided by its text."""
    e = read(spark, d, "documents").select("doc_id", F.posexplode(V.text_embedding(F.col("text"), PLACES)).alias("place", "value"))
    return rounded(e)


L6_SQL = f"""WITH v AS ({_embedding_sql(PLACES, 1)}), t AS ({_embedding_sql(PLACES, 0)}),
m AS (SELECT lang, list(a ORDER BY i) AS m FROM (SELECT lang, i, avg(x[i + 1]) AS a FROM t, range(0, {PLACES}) r(i) GROUP BY lang, i) GROUP BY lang),
g AS (SELECT v.doc_id, v.x, {_matvec(_sql_weights(PLACES, PLACES, 3), 'v.x', PLACES)} AS a, {_matvec(_sql_weights(PLACES, PLACES, 4), 'm.m', PLACES)} AS b FROM v JOIN m ON v.lang IS NOT DISTINCT FROM m.lang)
SELECT doc_id, i::INT AS place, round(x[i + 1] / (1 + exp(-(a[i + 1] + b[i + 1]))), 6) AS value FROM g, range(0, {PLACES}) r(i)"""


@query("L6", L6_SQL)
def l6(spark, d):
    """Each document's vector gated by itself and by its language's mean text vector."""
    docs = read(spark, d, "documents").select("doc_id", "lang", V.text_embedding(F.col("text"), PLACES, 1).alias("v"), V.text_embedding(F.col("text"), PLACES, 0).alias("t"))
    means = V.mean_vectors(docs, ["lang"], "t", PLACES).select(F.col("lang").alias("of"), "mean")
    gate = V.gated(F.col("v"), F.col("mean"), _weights(PLACES, PLACES, 3), _weights(PLACES, PLACES, 4))
    return rounded(docs.join(means, F.col("lang").eqNullSafe(F.col("of"))).select("doc_id", F.posexplode(gate).alias("place", "value")))


KERNELS, DILATIONS, INNER, OUTER = _weights(3, 3, 5), (1, 2, 3), _weights(2, 3, 6), _weights(3, 2, 7)


def _branch(k: int) -> str:
    taps = " + ".join(f"{w}::DOUBLE * coalesce(CASE WHEN i + {(j - 1) * DILATIONS[k]} BETWEEN 1 AND 64 THEN x[i + {(j - 1) * DILATIONS[k]}] END, 0)" for j, w in enumerate(KERNELS[k]))
    return f"list_transform(range(1, 65), lambda i: greatest(0::DOUBLE, {taps}))"


L7_SQL = f"""WITH e AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings),
b AS (SELECT vec_id, {_branch(0)} AS b0, {_branch(1)} AS b1, {_branch(2)} AS b2 FROM e),
m AS (SELECT *, [list_sum(b0) / 64, list_sum(b1) / 64, list_sum(b2) / 64] AS m FROM b),
h AS (SELECT *, list_transform({_matvec(_sql_weights(2, 3, 6), 'm', 3)}, lambda v: greatest(0::DOUBLE, v)) AS h FROM m),
l AS (SELECT *, {_matvec(_sql_weights(3, 2, 7), 'h', 2)} AS l FROM h),
w AS (SELECT *, list_transform(l, lambda v: exp(v) / list_sum(list_transform(l, lambda u: exp(u)))) AS w FROM l)
SELECT vec_id, (i - 1)::INT AS place, round(b0[i] * w[1] + b1[i] * w[2] + b2[i] * w[3], 6) AS value FROM w, range(1, 65) t(i)"""


@query("L7", L7_SQL)
def l7(spark, d):
    """Three dilated branches over an embedding's places, added up with softmax weights."""
    e = read(spark, d, "embeddings")
    x = F.col("embedding").cast("array<double>")
    return rounded(e.select("vec_id", F.posexplode(V.branch_attention(x, KERNELS, DILATIONS, INNER, OUTER)).alias("place", "value")))


A13_SQL = "SELECT (i - 1)::INT AS channel, count(*) AS n, round(avg(embedding[i]::DOUBLE), 6) AS mean, round(stddev_pop(embedding[i]::DOUBLE), 6) AS std FROM embeddings, range(1, 65) t(i) GROUP BY i"


@query("A13_incremental", A13_SQL)
def a13_incremental(spark, d):
    """Statistics of a growing folder: a first run over some of its files, a second that reads the new ones only."""
    scratch = Scratch(spark, "a13")
    folder, state = scratch.path("files"), scratch.path("state")
    e = read(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    e.where("vec_id % 3 <> 0").write.parquet(folder)
    states.updated_moments(spark, folder, "embedding", state)
    e.where("vec_id % 3 = 0").write.mode("append").parquet(folder)
    return rounded(states.updated_moments(spark, folder, "embedding", state)[0])


LINES = """CASE WHEN o_orderkey % 101 = 0 THEN CAST(o_orderkey AS VARCHAR) || ',' || o_orderpriority
  WHEN o_orderkey % 103 = 0 THEN CAST(o_orderkey AS VARCHAR) || ',x' || CAST(o_custkey AS VARCHAR) || ',' || o_orderpriority
  WHEN o_orderkey % 107 = 0 THEN CAST(o_orderkey AS VARCHAR) || ',' || CAST(o_custkey AS VARCHAR) || ',"' || o_orderpriority || ',",more'
  ELSE CAST(o_orderkey AS VARCHAR) || ',' || CAST(o_custkey AS VARCHAR) || ',"' || o_orderpriority || ', ok"' END"""
S13_SQL = f"""WITH l AS (SELECT *, {LINES} AS line FROM orders)
SELECT o_orderkey, CASE WHEN ok THEN o_custkey END AS o_custkey, CASE WHEN ok THEN o_orderpriority || ', ok' END AS priority, CASE WHEN NOT ok THEN line END AS text,
  CASE WHEN o_orderkey % 101 = 0 THEN 'number of fields' WHEN o_orderkey % 103 = 0 THEN 'value of the wrong type' WHEN o_orderkey % 107 = 0 THEN 'number of fields' END AS reason
FROM (SELECT *, o_orderkey % 101 <> 0 AND o_orderkey % 103 <> 0 AND o_orderkey % 107 <> 0 AS ok FROM l)"""


@query("S13_csv", S13_SQL)
def s13_csv(spark, d):
    """Orders as delimited lines, some of them malformed, read back: good rows typed, bad ones kept with a reason."""
    scratch = Scratch(spark, "s13")
    files, out = scratch.path("lines"), scratch.path("rows")
    read(spark, d, "orders").select(F.expr(LINES.replace("VARCHAR", "STRING")).alias("value")).write.text(files)
    from pyspark.sql.types import StructType

    rows, bad = records.checked_rows(spark, files, StructType.fromDDL("o_orderkey long, o_custkey long, priority string"), out)
    kept = bad.select(F.substring_index("text", ",", 1).cast("long").alias("o_orderkey"), F.lit(None).cast("long").alias("o_custkey"), F.lit(None).cast("string").alias("priority"), "text", "reason")
    return rows.select("*", F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("reason")).union(kept)


@query("K9_reuse", f"WITH {M} SELECT path, length(md5) * size_bytes + 7 AS made, row_pos % 5 <> 0 AND row_pos % 7 <> 0 AS reused FROM m")
def k9_reuse(spark, d):
    """A second run over a table in which some rows are new and some have changed: only these are processed."""
    cache = Scratch(spark, "k9").path("cache")
    now = manifest(spark, d).select("path", "size_bytes", F.col("row_pos").alias("modified_ms"), "md5")
    process = lambda df: df.withColumn("made", F.length("md5") * F.col("size_bytes") + 7)
    before = now.where("modified_ms % 5 <> 0").withColumn("size_bytes", F.col("size_bytes") + F.when(F.col("modified_ms") % 7 == 0, 1).otherwise(0))
    states.processed(before, {"plus": 7}, process, cache)
    return states.processed(now, {"plus": 7}, process, cache).select("path", "made", "reused")


LABEL_COUNTS = ", ".join(f"coalesce(sum(n) FILTER (label = {k}), 0)::BIGINT" for k in range(5))


def _greedy(counted: str, name: str = "c") -> str:
    """The greedy rule, group by group, from a table of (g, label, n): a recursive table s of (k, g, b). Loads are compared times 8
    for the shares 8, 1 and 1."""
    load = lambda i: f"list_sum(list_transform(range(1, 6), lambda j: s.cur[{i}][j] * o.c[j]))"
    return f"""{counted},
v AS (SELECT g, sum(n)::BIGINT AS size, [{LABEL_COUNTS}] AS c, string_agg(label || ':' || n, ',' ORDER BY label) AS text FROM {name} GROUP BY g),
o AS MATERIALIZED (SELECT g, c, row_number() OVER (ORDER BY size DESC, sha256('0:' || text), sha256('0:' || g)) AS k FROM v),
s AS (
  SELECT 0::BIGINT AS k, NULL::VARCHAR AS g, 0::BIGINT AS b, [[0, 0, 0, 0, 0], [0, 0, 0, 0, 0], [0, 0, 0, 0, 0]]::BIGINT[][] AS cur
  UNION ALL
  SELECT k, g, b, list_transform(range(1, 4), lambda i: CASE WHEN i = b THEN list_transform(range(1, 6), lambda j: cur[i][j] + c[j]) ELSE cur[i] END)
  FROM (SELECT *, list_position(loads, list_min(loads)) AS b FROM (
    SELECT o.k, o.g, o.c, s.cur, [{load(1)}, 8 * {load(2)}, 8 * {load(3)}] AS loads FROM s JOIN o ON o.k = s.k + 1))
)"""


@query("G6_rows", f"WITH RECURSIVE {M}, {_greedy('c AS (SELECT md5 AS g, label, count(*) AS n FROM m GROUP BY ALL)')} SELECT g AS \"group\", ['train', 'val', 'test'][b] AS new_split FROM s WHERE k > 0")
def g6_rows(spark, d):
    """The new split of every group of equal texts by the greedy rule."""
    counted = manifest(spark, d).groupBy(F.col("md5").alias("group"), "label").agg(F.count("*").alias("n"))
    return splits.greedy_assignment(counted, RATIOS)


A35_COUNTED = """r AS (SELECT (CASE WHEN md5 IS NULL THEN row_pos ELSE min(row_pos) OVER (PARTITION BY md5) END)::VARCHAR AS g, label FROM m WHERE label IS NOT NULL),
c AS (SELECT g, label, count(*) AS n FROM r GROUP BY ALL)"""


@query("A35", f"""WITH RECURSIVE {M}, {_greedy(A35_COUNTED)}
SELECT ['train', 'val', 'test'][b] AS new_split, sum(size)::BIGINT AS rows, count(*) AS groups, round(sum(size) / (SELECT sum(size) FROM v), 4) AS share FROM s JOIN v USING (g) GROUP BY b""")
def a35(spark, d):
    """Rows, groups and share that the greedy rule gives each split, groups named by their first row."""
    grouped = groups.group_key(manifest(spark, d), "row_pos", "md5", Scratch(spark, "a35"))
    return rounded(splits.achieved(splits.regenerate(grouped, RATIOS)), 4)


G7_COUNTED = "gc AS (SELECT md5 AS g, label, count(*) AS n FROM u GROUP BY ALL)"
G7_ROWS = "u AS MATERIALIZED (SELECT k.row_pos, md5, parsed AS label FROM k JOIN t USING (row_pos) WHERE included AND parsed IS NOT NULL)"


@query("G7_rows", f"WITH RECURSIVE {CLEAN}, {G7_ROWS}, {_greedy(G7_COUNTED, 'gc')} SELECT row_pos, ['train', 'val', 'test'][b] AS new_split FROM u JOIN s ON u.md5 = s.g")
def g7_rows(spark, d):
    """New splits of the included, labelled rows, as written and read back."""
    path = Scratch(spark, "g7").path("new")
    splits.regeneration(cleaned(spark, d), RATIOS, path, group="md5")
    written = spark.read.option("header", True).csv(f"{path}/splits")
    return written.select(F.col("row_pos").cast("long").alias("row_pos"), "new_split")


@query("K2_rows", f"WITH {CLEAN} SELECT row_pos, included, exclusion_rule, exclusion_reason FROM k")
def k2_rows(spark, d):
    """The clean manifest and the quarantine, row by row, as written and read back."""
    path = Scratch(spark, "k2").path("out")
    sinks.write_clean(cleaned(spark, d), path)
    return spark.read.parquet(f"{path}/rows").select("row_pos", F.col("included").cast("boolean").alias("included"), "exclusion_rule", "exclusion_reason")


@query("K4_rows", f"WITH {M} SELECT row_pos, id_code, label, split AS new_split FROM m")
def k4_rows(spark, d):
    """Split files row by row, as written and read back; ids stay text."""
    path = Scratch(spark, "k4").path("out")
    sinks.write_splits(manifest(spark, d).select("row_pos", "id_code", "label", F.col("split").alias("new_split")), path, {"seed": 0, "source": "documents"})
    read_back = spark.read.schema("row_pos long, id_code string, label int, new_split string").option("header", True).csv(f"{path}/splits")
    return read_back.select("row_pos", "id_code", "label", "new_split")
