"""Queries of the operator inventory over the supplied tables, with the SQL that DuckDB compares them with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from quillspark.functions import columns as C
from quillspark.operators import augmentation, epochs, evaluate, groups, profile, rules, splits
from quillspark.plans.tables import D, G, M, P, daily, grades, manifest, read, scores
from quillspark.scratch import Scratch
from quillspark.sources import manifests
from quillspark.sources.config import resolve_column

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def r(x: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(x) if isinstance(x, str) else x, digits)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Every double rounded, for comparison across engines."""
    return df.select(*(r(F.col(f"`{c}`"), digits).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes))


# --- Projections and rules -------------------------------------------------------------------------------------------

@query("P1", f"WITH {M} SELECT id_code, split, path FROM m WHERE readable")
def p1(spark, d):
    return manifest(spark, d).where("readable").select("id_code", "split", "path")


REASON = """CASE WHEN NOT "exists" THEN 'missing_file' WHEN size_bytes = 0 THEN 'zero_byte' WHEN NOT readable THEN 'unreadable' END"""


@query("P2", f"WITH {M} SELECT row_pos, {REASON} AS reason FROM m")
def p2(spark, d):
    return manifest(spark, d).select("row_pos", rules.integrity_reason().alias("reason"))


LABELS = """l AS (SELECT *, TRY_CAST(raw_label AS DOUBLE) IS NOT NULL AS label_present,
  CASE WHEN TRY_CAST(raw_label AS DOUBLE) = floor(TRY_CAST(raw_label AS DOUBLE)) THEN TRY_CAST(raw_label AS DOUBLE)::INT END AS parsed FROM m),
t AS (SELECT *, coalesce(parsed BETWEEN 0 AND 4, false) AS label_in_range, row_number() OVER (PARTITION BY split, id_code ORDER BY row_pos) > 1 AS repeated FROM l)"""


def labelled(spark: SparkSession, d: str) -> DataFrame:
    m = rules.with_labels(manifest(spark, d), "raw_label", 5)
    return rules.with_repeated(m, "split", "id_code")


@query("P3", f"WITH {M}, {LABELS} SELECT row_pos, label_present, parsed AS label, label_in_range FROM t")
def p3(spark, d):
    return labelled(spark, d).select("row_pos", "label_present", "label", "label_in_range")


LABEL_REASON = "CASE WHEN repeated THEN 'duplicate_id' WHEN label_present AND NOT label_in_range THEN 'label_out_of_range' WHEN NOT label_present THEN 'missing_label' END"


@query("P4", f"WITH {M}, {LABELS} SELECT row_pos, {LABEL_REASON} AS reason FROM t")
def p4(spark, d):
    return labelled(spark, d).select("row_pos", rules.labels_rule().reason.alias("reason"))


QUALITY = """lim AS (SELECT quantile_cont(sharpness, 0.05) AS blur, quantile_cont(noise_sigma, 0.95) AS noise FROM m),
q AS (SELECT m.*, array_to_string(list_sort(list_filter([CASE WHEN brightness < 6 THEN 'dark' END, CASE WHEN brightness > 14 THEN 'bright' END,
  CASE WHEN contrast < 12 THEN 'low_contrast' END, CASE WHEN sharpness < blur THEN 'blurry' END, CASE WHEN noise_sigma > noise THEN 'noisy' END],
  lambda x: x IS NOT NULL)), '|') AS quality_flags FROM m, lim)"""


def quality_rule(m: DataFrame) -> rules.Rule:
    limits = rules.percentile_limits(m, {"sharpness": 5, "noise_sigma": 95})
    return rules.quality({
        "dark": ("brightness", "<", 6.0),
        "bright": ("brightness", ">", 14.0),
        "low_contrast": ("contrast", "<", 12.0),
        "blurry": ("sharpness", "<", limits["sharpness"]),
        "noisy": ("noise_sigma", ">", limits["noise_sigma"]),
    })


@query("P5", f"WITH {M}, {QUALITY} SELECT row_pos, quality_flags FROM q")
def p5(spark, d):
    m = manifest(spark, d)
    return rules.apply_rules(m, [quality_rule(m)]).select("row_pos", "quality_flags")


GROUPS = """e AS (SELECT md5, count(*) AS n, count(DISTINCT split) AS splits FROM m GROUP BY md5 HAVING count(*) > 1),
x AS (SELECT m.*, coalesce(e.md5, '') AS md5_group, coalesce(n, 1) AS md5_group_size, coalesce(splits > 1, false) AS md5_cross_split,
  e.md5 IS NULL OR row_number() OVER (PARTITION BY m.md5 ORDER BY readable DESC, CASE split WHEN 'train' THEN 1 WHEN 'val' THEN 2 WHEN 'test' THEN 3 ELSE 4 END, id_code, row_pos) = 1 AS md5_keeper
  FROM m LEFT JOIN e USING (md5))"""
CLEAN = f"""{M}, {LABELS}, {GROUPS}, {QUALITY},
c AS (SELECT x.row_pos, x.split, x.md5_group, q.quality_flags,
  CASE WHEN NOT x."exists" THEN 'missing_file' WHEN x.size_bytes = 0 THEN 'zero_byte' WHEN NOT x.readable THEN 'unreadable' END AS r1,
  {LABEL_REASON.replace('repeated', 't.repeated')} AS r2,
  CASE WHEN NOT md5_keeper THEN 'duplicate of group ' || substr(md5_group, 1, 12) END AS r3
  FROM x JOIN t USING (row_pos) JOIN q USING (row_pos)),
k AS (SELECT *, coalesce(r1, r2, r3) AS exclusion_reason, CASE WHEN r1 IS NOT NULL THEN 'integrity' WHEN r2 IS NOT NULL THEN 'labels' WHEN r3 IS NOT NULL THEN 'exact_duplicates' END AS exclusion_rule,
  coalesce(r1, r2, r3) IS NULL AS included FROM c)"""


def cleaned(spark: SparkSession, d: str) -> DataFrame:
    m = rules.with_exact_groups(labelled(spark, d))
    return rules.apply_rules(m, [rules.integrity(m), rules.labels_rule(), rules.duplicates(), quality_rule(m)])


@query("P6", f"WITH {CLEAN} SELECT row_pos, included, exclusion_reason, exclusion_rule FROM k")
def p6(spark, d):
    return cleaned(spark, d).select("row_pos", "included", "exclusion_reason", "exclusion_rule")


@query("P7", f"WITH {CLEAN} SELECT row_pos, quality_flags FROM k WHERE included")
def p7(spark, d):
    return cleaned(spark, d).where("included").select("row_pos", "quality_flags")


@query("P10", f"WITH {M} SELECT id_code AS image_id, label AS grade, split, 'documents' AS dataset FROM m")
def p10(spark, d):
    return manifest(spark, d).withColumnsRenamed({"id_code": "image_id", "label": "grade"}).withColumn("dataset", F.lit("documents")).select("image_id", "grade", "split", "dataset")


@query("P11", f"WITH {M} SELECT row_pos, round(CASE WHEN height = 0 THEN 0 ELSE width::DOUBLE / height END, 6) AS aspect_ratio FROM m")
def p11(spark, d):
    return manifest(spark, d).select("row_pos", r(C.ratio(F.col("width"), F.col("height"), 0)).alias("aspect_ratio"))


@query("P12", f"WITH {M} SELECT path, width FROM m WHERE height > 0 AND width::DOUBLE / height BETWEEN 1.32 AND 1.60 ORDER BY width DESC, path LIMIT 20")
def p12(spark, d):
    m = manifest(spark, d).where("height > 0").where(C.ratio(F.col("width"), F.col("height")).between(1.32, 1.60))
    return m.orderBy(F.desc("width"), "path").limit(20).select("path", "width")


@query("P13", f"WITH {G} SELECT key, label >= 2 AS referable FROM g")
def p13(spark, d):
    return grades(spark, d).select("key", (F.col("label") >= 2).alias("referable"))


@query("P14", f"WITH {G} SELECT key, concat_ws(',', (label > 0)::INT, (label > 1)::INT, (label > 2)::INT, (label > 3)::INT) AS targets FROM g")
def p14(spark, d):
    return grades(spark, d).select("key", F.array_join(C.ordinal_targets(F.col("label"), 5).cast("array<string>"), ",").alias("targets"))


GATE = "CASE WHEN least(width, height) < 224 THEN 'low_resolution' END, CASE WHEN visible_fraction < 0.15 THEN 'little_visible' END, CASE WHEN brightness < 8 THEN 'too_dark' END, CASE WHEN brightness > 12 THEN 'too_bright' END"


@query("P16", f"""WITH {M}, v AS (SELECT *, contrast / 100 AS visible_fraction, noise_sigma / 5 AS color_score FROM m),
b AS (SELECT *, list_filter([{GATE}], lambda x: x IS NOT NULL) AS blocking,
  list_filter([CASE WHEN sharpness < 7 THEN 'blurry' END, CASE WHEN color_score < 1.05 THEN 'unusual_color' END], lambda x: x IS NOT NULL) AS soft FROM v)
SELECT row_pos, array_to_string(list_concat(blocking, soft), ',') AS warnings, len(blocking) = 0 AS acceptable FROM b""")
def p16(spark, d):
    m = manifest(spark, d).withColumns({"visible_fraction": F.col("contrast") / 100, "color_score": F.col("noise_sigma") / 5})
    return rules.upload_gate(m, dark=8, bright=12, sharp=7).select("row_pos", F.array_join("warnings", ",").alias("warnings"), "acceptable")


@query("P17", f"WITH {G} SELECT key, CASE WHEN confidence >= 0.75 THEN 'high' WHEN confidence >= 0.5 THEN 'moderate' ELSE 'low' END AS band FROM g")
def p17(spark, d):
    return grades(spark, d).select("key", C.confidence_band(F.col("confidence")).alias("band"))


@query("P18", f"""WITH {G} SELECT key, array_to_string(list_filter([CASE WHEN confidence < 0.5 THEN 'repeat_capture' END, CASE WHEN prediction >= 2 THEN 'refer' END,
  CASE WHEN prediction = 1 THEN 'follow_up' END, CASE WHEN prediction = 0 AND confidence >= 0.5 THEN 'routine' END], lambda x: x IS NOT NULL), ',') AS guidance FROM g""")
def p18(spark, d):
    sure = F.col("confidence") >= 0.5
    guidance = C.flags_when(repeat_capture=~sure, refer=F.col("prediction") >= 2, follow_up=F.col("prediction") == 1, routine=(F.col("prediction") == 0) & sure)
    return grades(spark, d).select("key", F.array_join(guidance, ",").alias("guidance"))


@query("P20", f"WITH {M}, {LABELS} SELECT path AS image, coalesce(parsed, -1) AS label, id_code, row_pos AS \"index\" FROM t")
def p20(spark, d):
    return labelled(spark, d).select(F.col("path").alias("image"), F.coalesce("label", F.lit(-1)).alias("label"), "id_code", F.col("row_pos").alias("index"))


# --- Scans -----------------------------------------------------------------------------------------------------------

@query("S1", f"WITH {M} SELECT split, count(*) AS n, min(id_code) AS first_id FROM m GROUP BY split")
def s1(spark, d):
    """The manifest is written as CSV files, a folder for each split, and scanned."""
    path = Scratch(spark, "s1").path("csv")
    manifest(spark, d).select("split", "id_code", F.col("label").alias("diagnosis")).write.partitionBy("split").option("header", True).csv(path)
    scan = manifests.split_scan(spark, {s: f"{path}/split={s}" for s in ("train", "val", "test")})
    return scan.groupBy("split").agg(F.count("*").alias("n"), F.min("id_code").alias("first_id"))


@query("S3", f"WITH {M} SELECT split, id_code, NULL::INT AS label FROM m WHERE split = 'test'")
def s3(spark, d):
    path = Scratch(spark, "s3").path("csv")
    manifest(spark, d).where("split = 'test'").select("id_code").write.option("header", True).csv(path)
    return manifests.split_scan(spark, {"test": path}).select("split", "id_code", F.col("raw_label").try_cast("int").alias("label"))


@query("S4", f"WITH {M} SELECT split, count(*) AS n, sum(label)::BIGINT AS labels FROM m GROUP BY split")
def s4(spark, d):
    scratch = Scratch(spark, "s4")
    path = scratch.path("manifest")
    manifest(spark, d).write.parquet(path)
    return manifests.stored_manifest(spark, path).groupBy("split").agg(F.count("*").alias("n"), F.sum("label").alias("labels"))


@query("S5", f"WITH {CLEAN} SELECT m.id_code, m.path, m.label FROM k JOIN m USING (row_pos) WHERE included AND k.split = 'val'")
def s5(spark, d):
    path = Scratch(spark, "s5").path("clean")
    m = manifest(spark, d)
    cleaned(spark, d).drop("label").join(m.select("row_pos", "label"), "row_pos").write.parquet(path)
    return manifests.split_manifest(spark, path, "val", lambda: m)


@query("S13", f"WITH {M} SELECT row_pos, TRY_CAST(raw_label AS DOUBLE) AS value FROM m WHERE TRY_CAST(raw_label AS DOUBLE) IS NOT NULL")
def s13(spark, d):
    return manifest(spark, d).select("row_pos", F.col("raw_label").try_cast("double").alias("value")).where("value IS NOT NULL")


@query("S2", "SELECT doc_id AS id, source AS label FROM documents")
def s2(spark, d):
    """Columns found by candidates, whatever their case and outer spaces."""
    docs = read(spark, d, "documents")
    one, other = (resolve_column(docs.columns, c, k) for c, k in (([" ID_CODE", "Doc_Id "], "id"), (["grade", "SOURCE"], "label")))
    return docs.select(F.col(one).alias("id"), F.col(other).alias("label"))


REQUIRED = ("id_code", "path", "label", "split", "camera")


@query("P15", f"WITH {M} SELECT 'rows' AS \"check\", count(*) > 0 AS passed FROM m" + "".join(f" UNION ALL SELECT 'column:{c}', {c != 'camera'}" for c in REQUIRED))
def p15(spark, d):
    return manifests.manifest_findings(manifest(spark, d), REQUIRED)


# --- Joins -----------------------------------------------------------------------------------------------------------

@query("J1", "SELECT d.doc_id, coalesce(l.quality, -1) AS quality, coalesce(l.toxic, -1) AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def j1(spark, d):
    return manifests.with_measurements(read(spark, d, "documents").select("doc_id"), read(spark, d, "labels"), {"quality": -1, "toxic": -1}, "doc_id")


@query("J2", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j2(spark, d):
    return manifests.unreferenced(read(spark, d, "documents").select("doc_id"), read(spark, d, "labels"), "doc_id")


@query("J3", f"WITH {M} SELECT row_pos, md5 FROM m WHERE md5 IN (SELECT md5 FROM m GROUP BY md5 HAVING count(DISTINCT split) > 1)")
def j3(spark, d):
    return splits.offenders(manifest(spark, d), "md5").select("row_pos", "md5")


def fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """Two 60-bit simhashes over distinct lower-case tokens: partial sums before the shuffle by document."""
    tokens = read(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(F.split(F.lower("text"), " "))).alias("t"))
    hashed = tokens.select("doc_id", F.md5(F.col("t").cast("binary")).alias("h"))
    parts = hashed.select("doc_id", F.conv(F.substring("h", 1, 15), 16, 10).cast("long").alias("one"), F.conv(F.substring("h", 16, 15), 16, 10).cast("long").alias("two"))
    # Two counters of 30 bits in each sum: a bit is set where more than half of the tokens set it.
    pair = F.lit(1 | 1 << 30)
    sums = parts.groupBy("doc_id").agg(F.count("*").alias("n"), *(F.sum(F.shiftright(c, b).bitwiseAND(pair)).alias(f"{c}{b}") for c in ("one", "two") for b in range(30)))

    def word(c: str) -> Column:
        low = lambda b: F.col(f"{c}{b}").bitwiseAND(F.lit((1 << 30) - 1))
        high = lambda b: F.shiftright(f"{c}{b}", 30)
        bits = [F.when(2 * half(b) > F.col("n"), F.lit(1 << (b + k)).cast("long")).otherwise(F.lit(0).cast("long")) for half, k in ((low, 0), (high, 30)) for b in range(30)]
        while len(bits) > 1:
            bits = [x + y for x, y in zip(bits[::2], bits[1::2])] + bits[len(bits) - len(bits) % 2 :]
        return bits[0]

    return sums.select("doc_id", word("one").alias("one"), word("two").alias("two"))


def _simhash(column: str, start: int) -> str:
    bits = " + ".join(f"CASE WHEN sum(((h{column} >> {b}) & 1) * 2 - 1) > 0 THEN {1 << b}::BIGINT ELSE 0 END" for b in range(60))
    return f"({bits})::BIGINT AS {column}"


FP = f"""tok AS (SELECT doc_id, unnest(list_distinct(string_split(lower(text), ' '))) AS t FROM documents),
hs AS (SELECT doc_id, ('0x' || substr(md5(t), 1, 15))::BIGINT AS hone, ('0x' || substr(md5(t), 16, 15))::BIGINT AS htwo FROM tok),
fp AS MATERIALIZED (SELECT doc_id, {_simhash('one', 1)}, {_simhash('two', 16)} FROM hs GROUP BY doc_id)"""
NEAR, BITS = 6, 60


def _closure(edges: str, nodes: str) -> str:
    """Recursive reachability: (n, low)."""
    return f"""SELECT n, min(m) AS low FROM (WITH RECURSIVE reach(n, m) AS (SELECT id, id FROM ({nodes}) UNION SELECT reach.n, ed.b FROM reach JOIN ({edges}) ed ON reach.m = ed.a) SELECT * FROM reach) GROUP BY n"""


def _edges(column: str) -> str:
    return f"SELECT x.doc_id AS a, y.doc_id AS b FROM fp x JOIN fp y ON x.doc_id <> y.doc_id AND bit_count(xor(x.{column}, y.{column})) <= {NEAR}"


@query("J4", f"WITH {FP} SELECT x.doc_id AS a, y.doc_id AS b FROM fp x JOIN fp y ON x.doc_id < y.doc_id AND bit_count(xor(x.one, y.one)) <= {NEAR}")
def j4(spark, d):
    scratch = Scratch(spark, "j4")
    return groups.all_near_pairs(scratch.table(fingerprints(spark, d), "fingerprints"), "doc_id", "one", NEAR, BITS, scratch)


@query("J5", f"WITH {G} SELECT key, prediction, c_name FROM g JOIN orders ON key = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey")
def j5(spark, d):
    o = grades(spark, d).join(read(spark, d, "orders").select(F.col("o_orderkey").alias("key"), "o_custkey"), "key")
    return o.join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left").select("key", "prediction", "c_name")


@query("J6", f"WITH {G} SELECT key, CASE prediction WHEN 0 THEN 'none' WHEN 1 THEN 'mild' WHEN 2 THEN 'moderate' ELSE 'class_' || prediction END AS class_name FROM g")
def j6(spark, d):
    return evaluate.with_class_names(grades(spark, d), "prediction", ["none", "mild", "moderate"]).select("key", "class_name")


@query("J7", "SELECT o_orderkey AS key, o_orderkey % 3 <> 0 AND o_custkey % 5 <> 0 AS reused FROM orders")
def j7(spark, d):
    now = read(spark, d, "orders").select(F.col("o_orderkey").alias("path"), F.col("o_custkey").alias("size_bytes"), F.lit(1).alias("modified_ms"))
    before = now.where("path % 3 <> 0").withColumn("modified_ms", F.when(F.col("size_bytes") % 5 == 0, 2).otherwise(1))
    kept, anew = manifests.reusable(now, before)
    return kept.select(F.col("path").alias("key"), F.lit(True).alias("reused")).union(anew.select("path", F.lit(False)))


@query("J8", f"WITH {M}, {LABELS} SELECT s.split, c.label::INT AS label, coalesce(n, 0) AS count FROM (SELECT DISTINCT split FROM t) s CROSS JOIN range(6) c(label) LEFT JOIN (SELECT split, parsed, count(*) AS n FROM t GROUP BY ALL) f ON f.split = s.split AND f.parsed = c.label")
def j8(spark, d):
    return profile.class_counts(labelled(spark, d), 6)


@query("J9", f"WITH {G} SELECT key, CASE WHEN confidence > 0 THEN (SELECT min(i) FROM range(10) t(i) WHERE confidence <= (i + 1) / 10.0::DOUBLE)::INT END AS bin FROM g")
def j9(spark, d):
    return grades(spark, d).select("key", evaluate.bin_of(F.col("confidence"), evaluate.edges(10)).alias("bin"))


# --- Aggregations ----------------------------------------------------------------------------------------------------

TOTALS = """count(*) AS rows, count_if(readable) AS readable, count_if(NOT "exists") AS missing, count_if("exists" AND size_bytes = 0) AS zero_byte,
  count_if("exists" AND size_bytes > 0 AND NOT readable) AS unreadable, sum(size_bytes)::BIGINT AS bytes"""


@query("A1", f"WITH {M} SELECT {TOTALS} FROM m")
def a1(spark, d):
    return profile.totals(manifest(spark, d))


@query("A2", f"WITH {M} SELECT split, {TOTALS} FROM m GROUP BY split")
def a2(spark, d):
    return profile.totals(manifest(spark, d), ["split"])


GRID = "gc AS (SELECT s.split, c.label::INT AS label, coalesce(n, 0) AS count FROM (SELECT DISTINCT split FROM m) s CROSS JOIN range(5) c(label) LEFT JOIN (SELECT split, label, count(*) AS n FROM m GROUP BY ALL) f ON f.split = s.split AND f.label = c.label)"


@query("A3", f"WITH {M}, {GRID} SELECT split, label, count FROM gc")
def a3(spark, d):
    return profile.class_counts(manifest(spark, d), 5)


@query("A4", f"WITH {M} SELECT coalesce(nullif(lang, ''), '<unknown>') AS value, count(*) AS count FROM m GROUP BY 1")
def a4(spark, d):
    return profile.value_counts(manifest(spark, d), "lang")


def _describe(c: str) -> str:
    return f"""SELECT '{c}' AS metric, count({c}) AS n, round(avg({c}), 6) AS mean, round(CASE WHEN count({c}) = 1 THEN 0 ELSE stddev_samp({c}) END, 6) AS std, round(min({c}), 6) AS min,
  round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS median, round(quantile_cont({c}, 0.75), 6) AS p75, round(max({c}), 6) AS max FROM m"""


METRICS = ("brightness", "contrast", "sharpness", "noise_sigma")


@query("A5", f"WITH {M} " + " UNION ALL ".join(map(_describe, METRICS)))
def a5(spark, d):
    return rounded(profile.describe(manifest(spark, d), METRICS))


@query("A6", f"WITH {M} SELECT count(DISTINCT nullif(md5, '')) AS \"distinct\" FROM m")
def a6(spark, d):
    return profile.distinct_keys(manifest(spark, d), "md5")


@query("A7", f"WITH {M} SELECT split, count(*) - count(DISTINCT id_code) AS repeated FROM m GROUP BY split")
def a7(spark, d):
    return profile.repeated_ids(manifest(spark, d))


@query("A8", f"WITH {M} SELECT width, height, count(*) AS count FROM m GROUP BY ALL ORDER BY count DESC, width, height LIMIT 10")
def a8(spark, d):
    return profile.top_pairs(manifest(spark, d), "width", "height")


WIDE = ", ".join(f'count(CASE WHEN label = {k} THEN id_code END) AS "{k}"' for k in range(5))


@query("A9", f"WITH {M} SELECT CASE WHEN grouping(split) = 1 THEN 'overall' ELSE split END AS split, {WIDE}, count(id_code) AS total FROM m GROUP BY ROLLUP (split)")
def a9(spark, d):
    return profile.contingency(manifest(spark, d), 5)


COUNTS = "ct AS (SELECT label, count(*)::DOUBLE AS c, sum(count(*)) OVER ()::DOUBLE AS n FROM m GROUP BY label)"


def class_totals(spark: SparkSession, d: str) -> DataFrame:
    return manifest(spark, d).groupBy("label").count()


@query("A10", f"""WITH {M}, {COUNTS}, z AS (SELECT max(c) AS hi, min(c) AS lo, -sum(c / n * log2(c / n)) AS h, 1 - sum((c / n) * (c / n)) AS gini FROM ct)
SELECT round(hi / lo, 6) AS ratio, round(h, 6) AS entropy, round(log2(5), 6) AS max_entropy, round(1 - h / log2(5), 6) AS imbalance_index, round(gini, 6) AS gini, round(pow(2, h), 6) AS effective_classes FROM z""")
def a10(spark, d):
    return rounded(profile.imbalance(class_totals(spark, d), 5))


CHI = """cells AS (SELECT split, label, count(*)::DOUBLE AS o FROM m GROUP BY ALL),
grid AS (SELECT split, label, coalesce(o, 0) AS o FROM (SELECT DISTINCT split FROM m) CROSS JOIN (SELECT DISTINCT label FROM m) LEFT JOIN cells USING (split, label)),
ex AS (SELECT *, sum(o) OVER (PARTITION BY split) * sum(o) OVER (PARTITION BY label) / sum(o) OVER () AS e, (SELECT (count(DISTINCT split) - 1) * (count(DISTINCT label) - 1) FROM grid) AS dof FROM grid),
chi AS (SELECT sum((o - e) * (o - e) / e) AS x, any_value(dof)::BIGINT AS dof FROM ex),
pv AS (SELECT x, dof, exp(-x / 2) * list_sum(list_transform(range(0, dof // 2), lambda i: pow(x / 2, i) / factorial(i::INT))) AS p FROM chi)"""


@query("A11", f"WITH {M}, {CHI} SELECT round(x, 6) AS statistic, dof, round(p, 6) AS p_value FROM pv")
def a11(spark, d):
    return rounded(profile.chi_square(profile.class_counts(manifest(spark, d), 5)))


WEIGHTS = {"inverse": "1 / c", "inverse_sqrt": "1 / sqrt(c)", "effective_number": "(1 - 0.9999::DOUBLE) / (1 - pow(0.9999::DOUBLE, c))", "balanced": "n / (5 * c)"}


@query("A12", f"WITH {M}, {COUNTS} " + " UNION ALL ".join(f"SELECT '{k}' AS strategy, label, round(({w}) / avg({w}) OVER (), 6) AS weight FROM ct" for k, w in WEIGHTS.items()))
def a12(spark, d):
    return rounded(profile.class_weight_table(class_totals(spark, d), list(WEIGHTS)))


@query("A13", "SELECT (i - 1)::INT AS channel, count(*) AS n, round(avg(embedding[i]::DOUBLE), 6) AS mean, round(stddev_pop(embedding[i]::DOUBLE), 6) AS std FROM embeddings, range(1, 65) t(i) GROUP BY i")
def a13(spark, d):
    return rounded(profile.channel_moments(read(spark, d, "embeddings").select(F.col("embedding").cast("array<double>").alias("embedding")), "embedding"))


@query("A14", f"WITH {M} SELECT md5, count(DISTINCT split) AS splits, count(*) AS rows FROM m GROUP BY md5 HAVING count(DISTINCT split) > 1")
def a14(spark, d):
    return splits.spanning_keys(manifest(spark, d), "md5")


@query("A15", f"WITH {M}, bad AS (SELECT source, count(*) AS n FROM m GROUP BY source HAVING count(DISTINCT split) > 1) SELECT 'overlap:source' AS \"check\", CASE WHEN count(*) > 0 THEN 'warn' ELSE 'pass' END AS status, count(*) AS \"values\", coalesce(sum(n), 0)::BIGINT AS rows FROM bad")
def a15(spark, d):
    return splits.overlap_check(manifest(spark, d), "source", "warn")


@query("A16", f"WITH {M}, {CHI} SELECT round(x, 6) AS statistic, dof, round(p, 6) AS p_value, CASE WHEN p < 0.05 THEN 'warn' ELSE 'pass' END AS status FROM pv")
def a16(spark, d):
    return rounded(splits.homogeneity_check(manifest(spark, d), 5))


@query("A17", f"WITH {M} SELECT s.split, c.label::INT AS label, coalesce(n, 0) AS count FROM (SELECT DISTINCT split FROM m) s CROSS JOIN range(5) c(label) LEFT JOIN (SELECT split, label, count(*) AS n FROM m GROUP BY ALL) f ON f.split = s.split AND f.label = c.label WHERE coalesce(n, 0) < 20")
def a17(spark, d):
    return splits.coverage_shortfalls(manifest(spark, d), 5, 20)


@query("A18", f"WITH {M} SELECT CASE WHEN count(*) > 0 THEN 'fail' ELSE 'pass' END AS status FROM (SELECT md5 FROM m GROUP BY md5 HAVING count(DISTINCT split) > 1)")
def a18(spark, d):
    m = manifest(spark, d)
    return splits.fold_status(splits.overlap_check(m, "md5").union(splits.overlap_check(m, "path")))


@query("A19", f"WITH {M}, {QUALITY} SELECT flag, count(*) AS count FROM (SELECT unnest(string_split(quality_flags, '|')) AS flag FROM q) WHERE flag <> '' GROUP BY flag")
def a19(spark, d):
    return rules.flag_histogram(p5(spark, d))


@query("A20", f"WITH {CLEAN} SELECT exclusion_rule, split, count(*) AS count FROM k WHERE NOT included GROUP BY ALL")
def a20(spark, d):
    return cleaned(spark, d).where("NOT included").groupBy("exclusion_rule", "split").count()


@query("A21", f"WITH {M}, {GROUPS} SELECT row_pos, md5_group, md5_group_size, md5_cross_split FROM x")
def a21(spark, d):
    return rules.with_exact_groups(manifest(spark, d)).select("row_pos", "md5_group", "md5_group_size", "md5_cross_split")


@query("A22", f"WITH {M} SELECT source, count(*) AS size, count(DISTINCT split) AS splits, count(DISTINCT split) > 1 AS cross_split FROM m GROUP BY source")
def a22(spark, d):
    return groups.cluster_summary(manifest(spark, d), "source")


CM = f"{G}, cm AS (SELECT t.i::INT AS truth, p.i::INT AS predicted, coalesce(n, 0) AS n FROM range(5) t(i) CROSS JOIN range(5) p(i) LEFT JOIN (SELECT label, prediction, count(*) AS n FROM g GROUP BY ALL) f ON f.label = t.i AND f.prediction = p.i)"


def matrix(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.confusion(grades(spark, d), 5)


@query("A23", f"WITH {CM} SELECT truth, predicted, n FROM cm")
def a23(spark, d):
    return matrix(spark, d)


@query("K6", f"WITH {CM} SELECT truth AS true_grade, " + ", ".join(f"sum(CASE WHEN predicted = {k} THEN n ELSE 0 END)::BIGINT AS pred_{k}" for k in range(5)) + " FROM cm GROUP BY truth")
def k6(spark, d):
    return evaluate.confusion_wide(matrix(spark, d), 5)


@query("A24", f"WITH {CM} SELECT truth, predicted, round(coalesce(n::DOUBLE / nullif(sum(n) OVER (PARTITION BY truth), 0), 0), 6) AS share FROM cm")
def a24(spark, d):
    return rounded(evaluate.row_normalized(matrix(spark, d)))


KAPPA = "SELECT 1 - sum(pow(truth - predicted, 2) * n) / sum(pow(truth - predicted, 2) * rr * cc / nn) AS qwk FROM (SELECT *, sum(n) OVER (PARTITION BY truth)::DOUBLE AS rr, sum(n) OVER (PARTITION BY predicted)::DOUBLE AS cc, sum(n) OVER ()::DOUBLE AS nn FROM cm)"


@query("A25", f"WITH {CM} SELECT round(qwk, 6) AS qwk FROM ({KAPPA})")
def a25(spark, d):
    return rounded(evaluate.quadratic_kappa(matrix(spark, d)))


@query("A26", f"WITH {G} SELECT round(avg((label = prediction)::INT), 6) AS accuracy, round(avg(abs(label - prediction)), 6) AS mae, round(avg((abs(label - prediction) <= 1)::INT), 6) AS within_one FROM g")
def a26(spark, d):
    return rounded(evaluate.agreement(matrix(spark, d)))


CLASSES = """pc AS (SELECT k.i::INT AS grade, sum(CASE WHEN truth = k.i AND predicted = k.i THEN n ELSE 0 END)::DOUBLE AS hit, sum(CASE WHEN truth = k.i THEN n ELSE 0 END)::BIGINT AS support,
  sum(CASE WHEN predicted = k.i THEN n ELSE 0 END)::DOUBLE AS pn FROM cm, range(5) k(i) GROUP BY k.i),
pf AS (SELECT grade, coalesce(hit / nullif(pn, 0), 0) AS prec, coalesce(hit / nullif(support, 0), 0) AS recall, coalesce(2 * hit / nullif(pn + support, 0), 0) AS f1, support FROM pc)"""


@query("A27", f"WITH {CM}, {CLASSES} SELECT grade, round(prec, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM pf")
def a27(spark, d):
    return rounded(evaluate.per_class(matrix(spark, d)))


AUC = """(SELECT (sum(CASE WHEN y THEN rk END) - p * (p + 1) / 2) / (p * q) AS auc FROM (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS rk,
  (count(*) FILTER (WHERE y) OVER ())::DOUBLE AS p, (count(*) FILTER (WHERE NOT y) OVER ())::DOUBLE AS q FROM (SELECT round(list_sum(probs[3:5]), 9) AS s, label >= 2 AS y FROM p)) GROUP BY p, q)"""


def predicted(spark: SparkSession, d: str) -> DataFrame:
    probs = scores(spark, d).withColumns({"probs": C.softmax(F.col("logits")), "ordinal_probs": C.sigmoid(F.col("ordinal_logits"))})
    return probs.withColumn("prediction", C.argmax(F.col("probs")))


@query("A28", f"WITH {P} SELECT round(auc, 6) AS auc FROM {AUC}")
def a28(spark, d):
    return rounded(evaluate.auc(predicted(spark, d), F.round(C.referable_probability(F.col("probs")), 9), F.col("label") >= 2))


@query("A29", f"WITH {G} SELECT round(avg((prediction < 2)::INT), 6) AS fnr FROM g WHERE label >= 2")
def a29(spark, d):
    return rounded(evaluate.referable_miss_rate(matrix(spark, d)))


BINS = f"""{P}, cf AS (SELECT list_max(probs) AS c, (list_position(probs, list_max(probs)) - 1 = label)::INT AS k FROM p),
rb AS (SELECT b.i::INT AS bin, (b.i + 0.5)::DOUBLE / 10 AS center, count(c) AS n, avg(k) AS accuracy, avg(c) AS confidence FROM range(10) b(i) LEFT JOIN cf ON c > b.i / 10.0::DOUBLE AND c <= (b.i + 1) / 10.0::DOUBLE GROUP BY b.i)"""


def reliable(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.reliability(predicted(spark, d), F.array_max("probs"), F.col("prediction") == F.col("label"))


@query("A30", f"WITH {BINS} SELECT round(sum(n * abs(accuracy - confidence)) / (SELECT count(*) FROM p), 6) AS ece FROM rb")
def a30(spark, d):
    return rounded(evaluate.calibration_error(reliable(spark, d), scores(spark, d).agg(F.count("*").alias("n"))))


@query("A31", f"WITH {BINS} SELECT bin, round(center, 6) AS center, n, round(accuracy, 6) AS accuracy, round(confidence, 6) AS confidence FROM rb")
def a31(spark, d):
    return rounded(reliable(spark, d))


PCM = "pr AS (SELECT *, (list_position(probs, list_max(probs)) - 1)::INT AS prediction FROM p), " + CM.removeprefix(f"{G}, ").replace("FROM g GROUP", "FROM pr GROUP")


@query("A32", f"""WITH {BINS}, {PCM}, {CLASSES},
me AS (SELECT avg((label = prediction)::INT) AS accuracy, avg(abs(label - prediction)) AS mae, avg((abs(label - prediction) <= 1)::INT) AS within_one,
  avg(CASE WHEN label >= 2 THEN (prediction < 2)::INT END) AS fnr, count(*) AS rows FROM pr)
SELECT round((SELECT qwk FROM ({KAPPA})), 6) AS qwk, round(accuracy, 6) AS accuracy, round(mae, 6) AS mae, round(within_one, 6) AS within_one,
  round((SELECT avg(f1) FROM pf), 6) AS macro_f1, round((SELECT auc FROM {AUC.replace("round(list_sum(probs[3:5]), 9)", "list_sum(probs[3:5])")}), 6) AS auc, round(fnr, 6) AS fnr,
  round((SELECT sum(n * abs(accuracy - confidence)) FROM rb) / rows, 6) AS ece, rows FROM me""")
def a32(spark, d):
    return rounded(evaluate.metric_bundle(predicted(spark, d), 5))


@query("A33", "SELECT round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) AS mean FROM lineitem")
def a33(spark, d):
    return rounded(evaluate.weighted_mean(read(spark, d, "lineitem"), "l_extendedprice", "l_quantity"), 4)


@query("A34", f"WITH {M}, {LABELS} SELECT coalesce(parsed, -1) AS label, count(*) AS count FROM t GROUP BY 1")
def a34(spark, d):
    return profile.label_histogram(labelled(spark, d))


@query("A36", f"WITH {P} SELECT vec_id, round(probs[2] + 2 * probs[3] + 3 * probs[4] + 4 * probs[5], 6) AS expected, round(probs[3] + probs[4] + probs[5], 6) AS referable FROM p")
def a36(spark, d):
    return predicted(spark, d).select("vec_id", r(C.expected_grade(F.col("probs"))).alias("expected"), r(C.referable_probability(F.col("probs"))).alias("referable"))


@query("A37", "SELECT (i - 1)::INT AS channel, round(avg(embedding[i]::DOUBLE), 6) AS mean, round(stddev_pop(embedding[i]::DOUBLE), 6) AS std FROM embeddings, range(1, 65) t(i) GROUP BY i")
def a37(spark, d):
    """Measured constants (mode auto without a cache), as a table."""
    e = read(spark, d, "embeddings").select(F.col("embedding").cast("array<double>").alias("embedding"))
    return rounded(profile.channel_moments(e, "embedding").drop("n"))


_MEASURED = "SELECT '{}' AS mode, (i - 1)::INT AS channel, round(avg(embedding[i]::DOUBLE), 6) AS mean, round(stddev_pop(embedding[i]::DOUBLE), 6) AS std FROM embeddings, range(1, 65) t(i) GROUP BY i"


@query("A37_modes", f"""SELECT * FROM (VALUES ('imagenet', 0, 0.485::DOUBLE, 0.229::DOUBLE), ('imagenet', 1, 0.456, 0.224), ('imagenet', 2, 0.406, 0.225), ('config', 0, 0.5, 0.25)) t(mode, channel, mean, std)
UNION ALL {_MEASURED.format("auto")} UNION ALL {_MEASURED.format("cached")}""")
def a37_modes(spark, d):
    """Every way in which constants are resolved; cached ones are those that a run of mode auto has measured."""
    e = read(spark, d, "embeddings").select(F.col("embedding").cast("array<double>").alias("embedding"))
    auto = profile.normalization(e, "auto", "embedding")
    cached = profile.normalization(None, "auto", cached={"key": "k", "mean": auto[0], "std": auto[1]}, key="k")
    found = {"imagenet": profile.normalization(None, "imagenet"), "config": profile.normalization(None, "config", given=([0.5], [0.25])), "auto": auto, "cached": cached}
    rows = [(mode, i, float(m), float(s)) for mode, (mean, std) in found.items() for i, (m, s) in enumerate(zip(mean, std))]  # a row a channel
    return rounded(spark.createDataFrame(rows, "mode string, channel int, mean double, std double"))


# --- Windows ---------------------------------------------------------------------------------------------------------

@query("W1", f"WITH {M}, {LABELS} SELECT row_pos, repeated FROM t")
def w1(spark, d):
    return labelled(spark, d).select("row_pos", "repeated")


@query("W2", f"WITH {M}, {GROUPS} SELECT row_pos, md5_keeper FROM x")
def w2(spark, d):
    return rules.with_exact_groups(manifest(spark, d)).select("row_pos", "md5_keeper")


BEST = "bs AS (SELECT *, coalesce(value > max(value) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), value IS NOT NULL) AS improved FROM d)"


@query("W3", f"WITH {D}, {BEST} SELECT day, value, improved FROM bs")
def w3(spark, d):
    return epochs.best_so_far(daily(spark, d), "day", "value").select("day", "value", "improved")


@query("K8", f"WITH {D}, {BEST} SELECT max(CASE WHEN improved THEN day END) AS best, max(day) AS last FROM bs")
def k8(spark, d):
    seen = epochs.best_so_far(daily(spark, d), "day", "value")
    return seen.agg(F.max(F.when(F.col("improved"), F.col("day"))).alias("best"), F.max("day").alias("last"))


@query("W4", f"""WITH {D}, {BEST}, ru AS (SELECT *, sum(improved::INT) OVER (ORDER BY day) AS run FROM bs),
wt AS (SELECT day, (sum((NOT improved)::INT) OVER (PARTITION BY run ORDER BY day))::BIGINT AS waited FROM ru)
SELECT day, waited, day = (SELECT min(day) FROM wt WHERE waited >= 5) AS stop FROM wt""")
def w4(spark, d):
    return epochs.early_stop(daily(spark, d), "day", "value", 5).select("day", "waited", "stop")


@query("W5", f"WITH {D} SELECT day, value FROM d ORDER BY value DESC, day LIMIT 1")
def w5(spark, d):
    return epochs.best_epoch(daily(spark, d), "day", "value").select("day", "value")


@query("W6", f"WITH {P}, so AS (SELECT vec_id, list_sort(probs, 'DESC') AS o, probs FROM p) SELECT vec_id, round(o[1] - o[2], 6) AS margin, (list_position(probs, o[2]) - 1)::INT AS closest FROM so")
def w6(spark, d):
    return predicted(spark, d).select("vec_id", r(C.top_two_margin(F.col("probs"))).alias("margin"), C.runner_up(F.col("probs")).alias("closest"))


PLACE = "pl AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5('7:' || o_orderkey), o_orderkey) - 1 AS place FROM orders)"


@query("W7", f"WITH {PLACE} SELECT o_orderkey, place, place // 64 AS batch FROM pl WHERE place // 64 < (SELECT count(*) // 64 FROM orders)")
def w7(spark, d):
    return epochs.batches(read(spark, d, "orders").select("o_orderkey"), "o_orderkey", 64, 7, drop_last=True).select("o_orderkey", "place", "batch")


@query("W8", f"""WITH {G}, b1 AS (SELECT key, 'correct' AS bucket, confidence FROM g WHERE label = prediction ORDER BY confidence DESC, key LIMIT 5),
b2 AS (SELECT key, 'severe_error' AS bucket, confidence FROM g WHERE abs(label - prediction) >= 2 ORDER BY confidence DESC, key LIMIT 5),
b3 AS (SELECT key, 'any_error' AS bucket, confidence FROM g WHERE label <> prediction AND key NOT IN (SELECT key FROM b2) ORDER BY confidence DESC, key LIMIT 5)
SELECT * FROM b1 UNION ALL SELECT * FROM b2 UNION ALL SELECT * FROM b3""")
def w8(spark, d):
    apart = F.abs(F.col("label") - F.col("prediction"))
    return epochs.representative(grades(spark, d), [("correct", apart == 0), ("severe_error", apart >= 2), ("any_error", apart > 0)], "confidence", "key", 5).select("key", "bucket", "confidence")


@query("W9", f"WITH {M}, {GRID} SELECT split, label, round_even(count::DOUBLE / sum(count) OVER (PARTITION BY split), 4) AS share FROM gc")
def w9(spark, d):
    return splits.proportions(manifest(spark, d), 5)


# --- Sorting, sampling, sets -----------------------------------------------------------------------------------------

@query("O2", f"WITH {M} SELECT row_pos, size_bytes FROM m ORDER BY size_bytes DESC, row_pos LIMIT 20")
def o2(spark, d):
    return manifest(spark, d).orderBy(F.desc("size_bytes"), "row_pos").limit(20).select("row_pos", "size_bytes")


@query("O3", "SELECT o_orderkey FROM orders ORDER BY md5('3:' || o_orderkey), o_orderkey LIMIT 100")
def o3(spark, d):
    return epochs.seeded_sample(read(spark, d, "orders").select("o_orderkey"), "o_orderkey", 100, 3)


@query("O5", f"WITH {PLACE} SELECT o_orderkey, place FROM pl")
def o5(spark, d):
    return epochs.permutation(read(spark, d, "orders").select("o_orderkey"), "o_orderkey", 7)


@query("O6", f"WITH {M} SELECT id_code, 'a' AS part FROM m WHERE split = 'val' UNION ALL SELECT id_code, 'b' FROM m WHERE split = 'test'")
def o6(spark, d):
    m = manifest(spark, d)
    return m.where("split = 'val'").select("id_code", F.lit("a").alias("part")).unionByName(m.where("split = 'test'").select("id_code", F.lit("b").alias("part")))


@query("O7", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
def o7(spark, d):
    return read(spark, d, "customer").select("c_custkey").exceptAll(read(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")))


@query("O8", f"WITH {M} SELECT row_pos, min(row_pos) OVER (PARTITION BY source, label) AS cluster FROM m")
def o8(spark, d):
    return groups.partition_intersection(manifest(spark, d), ["source", "label"], "row_pos").select("row_pos", "cluster")


@query("O9", f"WITH {M} SELECT DISTINCT source, split FROM m")
def o9(spark, d):
    return manifest(spark, d).select("source", "split").distinct()


@query("O10", f"WITH {M} SELECT row_pos, ('0x' || substr(sha256('5:augment/' || row_pos), 1, 8))::BIGINT AS augment, ('0x' || substr(sha256('5:split/' || row_pos), 1, 8))::BIGINT AS split FROM m")
def o10(spark, d):
    """Each stage has seeds of its own for each row, whatever other stages draw."""
    seed = lambda stage: C.derive_seed(5, F.concat(F.lit(f"{stage}/"), F.col("row_pos").cast("string")))
    return manifest(spark, d).select("row_pos", seed("augment").alias("augment"), seed("split").alias("split"))


_STEPS = ", ".join(f"({i}, '{n}', '{e}', '{p}')" for i, _, n, e, p in augmentation.policy())
_DRAWN = "('0x' || substr(sha256('11:' || row_pos || '/' || name), 1, 8))::BIGINT"


@query("X10", f"WITH {M}, po(step, name, evidence, priority) AS (VALUES {_STEPS}) SELECT row_pos, step, name, evidence, priority, {_DRAWN} AS step_seed FROM m, po WHERE {_DRAWN} % 100 < 50")
def x10(spark, d):
    return augmentation.augmentation_plan(manifest(spark, d), "row_pos", 11)


@query("X12", f"WITH {M}, po(step, name, evidence, priority) AS (VALUES {_STEPS}) SELECT name, count(*) AS n FROM m, po WHERE evidence <> 'eda' AND {_DRAWN} % 100 < 50 GROUP BY name")
def x12(spark, d):
    """The profile that follows the paper leaves out the steps that rest on the data's exploration alone."""
    return augmentation.augmentation_plan(manifest(spark, d), "row_pos", 11, profile="paper_faithful").groupBy("name").agg(F.count("*").alias("n"))


# --- Scalars and losses ----------------------------------------------------------------------------------------------

@query("F1", "SELECT doc_id, md5(text) AS md5, substr(sha256(text), 1, 12) AS short, ('0x' || substr(sha256('13:' || source), 1, 8))::BIGINT AS seed FROM documents")
def f1(spark, d):
    return read(spark, d, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("md5"), F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 12).alias("short"), C.derive_seed(13, F.col("source")).alias("seed"))


@query("F2", "SELECT doc_id, bit_count(xor(('0x' || substr(md5(text), 1, 15))::BIGINT, ('0x' || substr(md5(source), 1, 15))::BIGINT))::INT AS distance FROM documents")
def f2(spark, d):
    part = lambda c: C.hex_to_signed(F.substring(F.md5(F.col(c).cast("binary")), 1, 15))
    return read(spark, d, "documents").select("doc_id", C.hamming(part("text"), part("source")).cast("int").alias("distance"))


SIZE = "CASE WHEN n_chars < 1024 THEN printf('%.1f B', n_chars::DOUBLE) " + " ".join(f"WHEN n_chars < {1024 ** (i + 1)} THEN printf('%.1f {u}', round(n_chars / {1024**i}.0::DOUBLE, 1))" for i, u in enumerate(("KB", "MB", "GB"), 1)) + " ELSE printf('%.1f TB', round(n_chars / 1099511627776.0::DOUBLE, 1)) END"


@query("F3", f"SELECT doc_id, upper(trim(source)) AS name, {SIZE} AS size FROM documents")
def f3(spark, d):
    return read(spark, d, "documents").select("doc_id", F.upper(F.trim("source")).alias("name"), C.human_bytes(F.col("n_chars")).alias("size"))


@query("F5", f"WITH {P} SELECT vec_id, round(list_max(probs), 6) AS top, (list_position(probs, list_max(probs)) - 1)::INT AS grade, round(list_sum(ordinal_probs), 6) AS ordinal FROM p")
def f5(spark, d):
    return predicted(spark, d).select("vec_id", r(F.array_max("probs")).alias("top"), F.col("prediction").alias("grade"), r(C.total(F.col("ordinal_probs"))).alias("ordinal"))


@query("F10", f"WITH {P}, so AS (SELECT vec_id, list_sort(probs, 'DESC') AS o FROM p) SELECT vec_id, CASE WHEN o[1] >= 0.5 AND o[1] - o[2] >= 0.15 THEN 'conclusive' ELSE 'inconclusive' END AS status FROM so")
def f10(spark, d):
    return predicted(spark, d).select("vec_id", C.triage(F.col("probs")).alias("status"))


LOGS = f"{P}, lp AS (SELECT *, list_transform(probs, lambda x: ln(x)) AS logp, list_transform(range(0, 4), lambda k: CASE WHEN label > k THEN 1 ELSE 0 END) AS v FROM p)"
ORDINAL = "list_sum(list_transform(range(1, 5), lambda i: greatest(ordinal_logits[i], 0) - ordinal_logits[i] * v[i] + ln(1 + exp(-abs(ordinal_logits[i]))))) / 4"
CROSS = "-(0.9::DOUBLE * logp[label + 1] + 0.1::DOUBLE * list_sum(logp) / 5)"


@query("L1", f"WITH {LOGS} SELECT vec_id, round({CROSS}, 6) AS loss FROM lp")
def l1(spark, d):
    return scores(spark, d).select("vec_id", r(C.cross_entropy(F.col("logits"), F.col("label"), 0.1)).alias("loss"))


@query("L2", f"WITH {LOGS} SELECT vec_id, round({ORDINAL}, 6) AS loss FROM lp")
def l2(spark, d):
    return scores(spark, d).select("vec_id", r(C.ordinal_loss(F.col("ordinal_logits"), F.col("label"))).alias("loss"))


@query("L3", f"WITH {LOGS} SELECT vec_id, round(0.7::DOUBLE * ({CROSS}) + 0.3::DOUBLE * ({ORDINAL}), 5) AS loss FROM lp")
def l3(spark, d):
    both = C.total_loss(C.cross_entropy(F.col("logits"), F.col("label"), 0.1), C.ordinal_loss(F.col("ordinal_logits"), F.col("label")), 0.7)
    return scores(spark, d).select("vec_id", r(both, 5).alias("loss"))


@query("X6", "SELECT vec_id, round(list_sum(list_transform(range(1, 65), lambda i: (embedding[i]::DOUBLE - 0.5) / 0.25 * i)), 4) AS total FROM embeddings")
def x6(spark, d):
    e = read(spark, d, "embeddings")
    flat = C.normalize(F.col("embedding"), F.array_repeat(F.lit(0.5), 64), F.array_repeat(F.lit(0.25), 64))
    return e.select("vec_id", r(C.total(F.transform(flat, lambda x, i: x * (i + 1))), 4).alias("total"))


# --- Groups and splits -----------------------------------------------------------------------------------------------

NODES = "SELECT doc_id AS id FROM fp"


@query("G2", f"WITH {FP}, c1 AS ({_closure(_edges('one'), NODES)}) SELECT n AS doc_id, low AS cluster FROM c1")
def g2(spark, d):
    scratch = Scratch(spark, "g2")
    return groups.clusters(scratch.table(fingerprints(spark, d), "fingerprints"), "doc_id", "one", NEAR, scratch, BITS).select("doc_id", "cluster")


@query("G3", f"WITH {FP}, c1 AS ({_closure(_edges('one'), NODES)}), c2 AS ({_closure(_edges('two'), NODES)}) SELECT c1.n AS doc_id, min(c1.n) OVER (PARTITION BY c1.low, c2.low) AS cluster FROM c1 JOIN c2 USING (n)")
def g3(spark, d):
    scratch = Scratch(spark, "g3")
    return groups.dual_clusters(scratch.table(fingerprints(spark, d), "fingerprints"), "doc_id", "one", "two", NEAR, scratch, BITS).select("doc_id", "cluster")


KEYS = "ky AS (SELECT row_pos AS id, md5 AS k1, CAST(size_bytes AS VARCHAR) AS k2 FROM m)"
SHARED = "SELECT x.id AS a, y.id AS b FROM ky x JOIN ky y ON x.id <> y.id AND (x.k1 = y.k1 OR (x.k2 <> '' AND x.k2 = y.k2))"


@query("G4", f"WITH {M}, {KEYS}, gr AS ({_closure(SHARED, 'SELECT id FROM ky')}) SELECT n AS row_pos, low AS \"group\" FROM gr")
def g4(spark, d):
    return groups.merged_groups(manifest(spark, d), "row_pos", ["md5", "size_bytes"], Scratch(spark, "g4")).select("row_pos", "group")


@query("G5", f"WITH {M} SELECT row_pos, min(row_pos) OVER (PARTITION BY md5) AS \"group\" FROM m")
def g5(spark, d):
    return groups.group_key(manifest(spark, d), "row_pos", "md5", Scratch(spark, "g5")).select("row_pos", "group")


@query("G8_strict", f"WITH {M} SELECT 'md5' AS key, count(*) > 0 AS raised FROM (SELECT md5 FROM m GROUP BY md5 HAVING count(DISTINCT split) > 1) UNION ALL SELECT 'row_pos', false")
def g8_strict(spark, d):
    """Strict mode raises where a key spans splits, and only there."""
    def raised(key: str) -> bool:
        try:
            splits.require_disjoint(manifest(spark, d), key)
        except splits.LeakageError:
            return True
        return False

    return spark.createDataFrame([(k, raised(k)) for k in ("md5", "row_pos")], "key string, raised boolean")


RATIOS = {"train": 0.8, "val": 0.1, "test": 0.1}


@query("G7", f"WITH {CLEAN} SELECT count(*) AS planned, count(*) AS written, 0::BIGINT AS spanning, true AS refused FROM k JOIN t USING (row_pos) WHERE included AND parsed IS NOT NULL")
def g7(spark, d):
    """A dry run, a written plan, and a second one to the same place, which is refused."""
    scratch = Scratch(spark, "g7")
    path = scratch.path("new")
    rows = scratch.table(groups.group_key(cleaned(spark, d), "row_pos", "md5", scratch), "grouped")
    plan = splits.regeneration(rows, RATIOS)
    splits.regeneration(rows, RATIOS, path)
    try:
        splits.regeneration(rows, RATIOS, path)
        refused = False
    except AnalysisException:
        refused = True
    spanning = plan.groupBy("group", "new_split").count().groupBy("group").count().where("count > 1")
    written = spark.read.option("header", True).csv(f"{path}/splits")
    counts = [x.agg(F.count("*").alias(n)) for x, n in ((plan, "planned"), (written, "written"), (spanning, "spanning"))]
    return counts[0].crossJoin(counts[1]).crossJoin(counts[2]).withColumn("refused", F.lit(refused))




@query("G6", f"WITH {M} SELECT count(*) AS rows, count(DISTINCT md5) AS groups, 0::BIGINT AS spanning FROM m")
def g6(spark, d):
    """Every row is assigned and no group spans splits, whatever the order of equal groups."""
    grouped = groups.group_key(manifest(spark, d), "row_pos", "md5", Scratch(spark, "g6"))
    new = splits.regenerate(grouped, RATIOS)
    per = new.groupBy("group", "new_split").count().groupBy("group").agg(F.count("*").alias("k"), F.sum("count").alias("n"))
    return per.agg(F.sum("n").alias("rows"), F.count("*").alias("groups"), F.count_if(F.col("k") > 1).alias("spanning"))
