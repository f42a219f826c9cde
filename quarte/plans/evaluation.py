"""Evaluation, catalog and table-form queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarte.functions import codes, geometry as g
from quarte.operators import evaluate as ev, motion, repair as rp
from quarte.operators.series import spread_join
from quarte.plans import views as v
from quarte.plans.projections import BOXED, boxed
from quarte.plans.registry import big, query, rnd, yes
from quarte.plans.views import sql
from quarte.session import shared_path
from quarte.sources import adapters as src, tables

SIDE = ["phrase_id", "side"]
K = "phrase_id, side, frame"


@query("pose_scan", sql(f"SELECT {K}, kp::BIGINT AS kp, x, y FROM joints", "joints"))
def pose_scan(spark, sf):
    """Joint sheets with text cells and kp_N headers, written as CSV and read back as long rows."""
    sheets = tables.to_sheets(src.poses(spark, sf))
    text = sheets.select(
        "phrase_id", "sheet", "frame",
        *[F.coalesce(F.col(f"kp_{k}").cast("string"), F.lit("n/a")).alias(f"kp_{k}") for k in range(17)],
    )
    path = shared_path(spark, "sheets")
    text.write.option("header", "true").csv(path)
    stored = spark.read.schema(text.schema).option("header", "true").csv(path)
    return tables.scan_sheets(stored).withColumn("kp", big("kp"))


@query(
    "pose_scan_scaled",
    sql(
        f"SELECT {K}, {v.rnd('CASE WHEN x16 * c - 1.8 > 0 THEN x16 * c - 1.8 END', 9)} AS x, {v.rnd('CASE WHEN y16 * c - 1.8 > 0 THEN y16 * c - 1.8 END', 9)} AS y FROM "
        "(SELECT *, CASE WHEN phrase_id % 3 = 0 THEN 1.0 ELSE 1 + phrase_id / 8.0 END::DOUBLE AS c FROM poses)",
        "poses",
    ),
)
def pose_scan_scaled(spark, sf):
    """Joints times the constant of their phrase; a value at or below the edge is missing."""
    rows = src.poses(spark, sf).select(*SIDE, "frame", "x16", "y16")
    phrases = src.table(spark, sf, "embeddings").select(F.expr(src.PHRASE).alias("phrase_id")).distinct()
    constants = phrases.where("phrase_id % 3 <> 0").withColumn("c", 1 + F.col("phrase_id") / 8.0)
    rows = ev.with_constant(rows, constants)
    cell = lambda a: F.col(f"{a}16") * F.col("c") - 1.8
    return rows.select(*SIDE, "frame", *[rnd(F.when(cell(a) > 0, cell(a)), 9).alias(a) for a in "xy"])


@query(
    "pose_sink",
    sql(
        " UNION ALL ".join(
            f"SELECT phrase_id, '{s.title()}_{a.upper()}' AS sheet, frame, " + ", ".join(f"{a}{k} AS kp_{k}" for k in range(17)) + f" FROM poses WHERE side = '{s}'"
            for s in ("left", "right") for a in "xy"
        ),
        "poses",
    ),
)
def pose_sink(spark, sf):
    """Sheets written twice; the second run replaces the first."""
    poses, path = src.poses(spark, sf), shared_path(spark, "sheets")
    tables.write_sheets(poses.limit(1), path)
    tables.write_sheets(poses, path)
    return spark.read.parquet(path).select(*tables.to_sheets(poses).columns)


def _filled(a: str) -> str:
    over = "OVER (PARTITION BY phrase_id, side, kp ORDER BY frame ROWS BETWEEN"
    back, ahead = f"{over} UNBOUNDED PRECEDING AND CURRENT ROW)", f"{over} CURRENT ROW AND UNBOUNDED FOLLOWING)"
    at = f"CASE WHEN {a} IS NOT NULL THEN frame END IGNORE NULLS"
    bf, bv, af, av = f"last_value({at}) {back}", f"last_value({a} IGNORE NULLS) {back}", f"first_value({at}) {ahead}", f"first_value({a} IGNORE NULLS) {ahead}"
    return f"{v.rnd(f'coalesce({a}, {bv} + ({av} - {bv}) * (frame - {bf}) / ({af} - {bf}), {bv}, {av}, 0)', 9)} AS {a}"


@query("sheet_scan_filled", sql(f"SELECT {K}, kp::BIGINT AS kp, {_filled('x')}, {_filled('y')} FROM joints", "joints"))
def sheet_scan_filled(spark, sf):
    """Joint sheets as they are stored, read and filled: linear between values, the nearest at the ends, 0 without any."""
    path = shared_path(spark, "sheets")
    tables.write_sheets(src.poses(spark, sf), path)
    rows = motion.fill_all(tables.read_sheets(spark, path), [*SIDE, "kp"], "frame", ["x", "y"])
    return rows.select(*SIDE, "frame", big("kp").alias("kp"), rnd("x", 9).alias("x"), rnd("y", 9).alias("y"))


@query(
    "artifact_catalog",
    sql(
        "SELECT phrase_id, name, score, n_videos FROM (SELECT phrase_id, name, score, count(*) OVER (PARTITION BY phrase_id) AS n_videos, row_number() OVER (PARTITION BY phrase_id ORDER BY score, lower(name)) AS r FROM "
        "(SELECT *, (CASE WHEN name LIKE '%.mp4' THEN 0 ELSE 1 END + CASE WHEN contains(name, 'overlay') THEN 100 ELSE 0 END - CASE WHEN contains(name, 'corrected') THEN 10 ELSE 0 END)::BIGINT AS score FROM artifacts WHERE name NOT LIKE '%.json')) WHERE r = 1",
        "artifacts",
    ),
)
def artifact_catalog(spark, sf):
    return ev.best_videos(src.artifacts(spark, sf)).withColumn("score", big("score"))


STATUS = {
    "st": "SELECT phrase_id, CASE WHEN m AND j THEN 'complete' WHEN j THEN 'uploaded' WHEN m THEN 'incomplete' END AS status, b FROM (SELECT phrase_id, bool_or(name LIKE '%.mp4') AS m, bool_or(name LIKE '%.json') AS j, coalesce(sum(length) FILTER (name LIKE '%.mp4'), 0)::BIGINT AS b FROM artifacts GROUP BY phrase_id)"
}


@query("match_catalog", sql("SELECT phrase_id, status, b AS bytes FROM st WHERE status IS NOT NULL", "artifacts", **STATUS))
def match_catalog(spark, sf):
    return ev.match_status(src.artifacts(spark, sf))


@query("page_matches", sql("SELECT phrase_id, status, total FROM (SELECT *, count(*) OVER () AS total FROM st WHERE status IS NOT NULL) ORDER BY phrase_id DESC LIMIT 50 OFFSET 50", "artifacts", **STATUS))
def page_matches(spark, sf):
    found = ev.match_status(src.artifacts(spark, sf))
    total = found.agg(F.count("status").alias("total"))
    second = ev.page(found, [F.desc("phrase_id")], 2, 50).select("phrase_id", "status")
    # One row of totals: its size does not grow with the data.
    return second.join(F.broadcast(total))


@query("keyset_page", sql("SELECT phrase_id, status FROM st WHERE status IS NOT NULL AND phrase_id > 40 ORDER BY phrase_id LIMIT 25", "artifacts", **STATUS))
def keyset_page(spark, sf):
    return ev.keyset_page(ev.match_status(src.artifacts(spark, sf)), "phrase_id", 40, 25).select("phrase_id", "status")


DIRS = {"dirs": "SELECT DISTINCT phrase_id, 'p' || phrase_id AS name FROM artifacts", "done": "SELECT DISTINCT phrase_id FROM artifacts WHERE name LIKE '%.json'"}


@query("phrase_dir_filter", sql("SELECT phrase_id, name FROM dirs WHERE name > 'p2' AND phrase_id NOT IN (SELECT phrase_id FROM done) ORDER BY name LIMIT 40", "artifacts", **DIRS))
def phrase_dir_filter(spark, sf):
    files = src.artifacts(spark, sf)
    dirs = files.select("phrase_id", F.concat(F.lit("p"), F.col("phrase_id").cast("string")).alias("name")).distinct()
    done = files.where(F.col("name").endswith(".json"))
    return ev.keyset_page(dirs.join(done, "phrase_id", "left_anti"), "name", "p2", 40)


@query("skip_existing", sql("SELECT phrase_id FROM dirs WHERE phrase_id NOT IN (SELECT phrase_id FROM done)", "artifacts", **DIRS))
def skip_existing(spark, sf):
    files = src.artifacts(spark, sf)
    return files.select("phrase_id").distinct().join(files.where(F.col("name").endswith(".json")), "phrase_id", "left_anti")


@query(
    "missing_artifacts",
    sql("SELECT count(*) FILTER (NOT j)::BIGINT AS no_record, count(*) FILTER (NOT m)::BIGINT AS no_video, count(*) FILTER (j AND m)::BIGINT AS usable FROM (SELECT phrase_id, bool_or(name LIKE '%.json') AS j, bool_or(name LIKE '%.mp4') AS m FROM artifacts GROUP BY phrase_id)", "artifacts"),
)
def missing_artifacts(spark, sf):
    files = src.artifacts(spark, sf)
    per = files.groupBy("phrase_id").agg(F.bool_or(F.col("name").endswith(".json")).alias("j"), F.bool_or(F.col("name").endswith(".mp4")).alias("m"))
    return per.agg(F.count_if(~F.col("j")).alias("no_record"), F.count_if(~F.col("m")).alias("no_video"), F.count_if(F.col("j") & F.col("m")).alias("usable"))


@query("result_scan", sql(f"SELECT doc_id, {v.rnd('coalesce(CASE WHEN doc_id % 3 = 0 THEN n_chars / 7.0 END, CASE WHEN doc_id % 5 = 0 THEN n_chars / 9.0 END, 1.0)')} AS c FROM documents"))
def result_scan(spark, sf):
    """Constant from the first of two result files that has one, else 1."""
    docs = src.table(spark, sf, "documents").select("doc_id", "n_chars")
    first = docs.where("doc_id % 3 = 0").select("doc_id", (F.col("n_chars") / 7.0).alias("c1"))
    second = docs.where("doc_id % 5 = 0").select("doc_id", (F.col("n_chars") / 9.0).alias("c2"))
    rows = docs.select("doc_id").join(first, "doc_id", "left").join(second, "doc_id", "left")
    return rows.select("doc_id", rnd(F.coalesce("c1", "c2", F.lit(1.0))).alias("c"))


@query(
    "decision_json",
    sql("SELECT event_id, '{\"winner\":' || CASE WHEN event_id % 3 = 0 THEN 'null' ELSE '\"left\"' END || ',\"frames\":[1,' || (event_id % 9) || '],\"score\":' || CASE WHEN event_id % 4 < 2 THEN 'null' ELSE (event_id % 8)::VARCHAR || '.5' END || '}' AS body FROM events"),
)
def decision_json(spark, sf):
    """Null-safe JSON: NaN and infinities become null and null fields stay."""
    i = F.col("event_id")
    raw = F.when(i % 4 == 0, F.lit(float("nan"))).when(i % 4 == 1, F.lit(float("inf"))).otherwise(i % 8 + 0.5)
    body = F.struct(
        F.when(i % 3 != 0, "left").alias("winner"), F.array(F.lit(1), (i % 9).cast("int")).alias("frames"), tables.finite(raw).alias("score")
    )
    return src.table(spark, sf, "events").select("event_id", tables.null_safe_json(body).alias("body"))


@query(
    "bucket_sink",
    sql("SELECT item_id, CASE WHEN predicted = label THEN 'correct' ELSE 'mismatch' END || '/' || CASE WHEN confidence = 'high' THEN 'blade_contact' ELSE 'no_blade_contact' END AS bucket FROM predictions", "predictions"),
)
def bucket_sink(spark, sf):
    right = F.when(F.col("predicted") == F.col("label"), "correct").otherwise("mismatch")
    contact = F.when(F.col("confidence") == "high", "blade_contact").otherwise("no_blade_contact")
    rows = src.predictions(spark, sf).select("item_id", F.concat(right, F.lit("/"), contact).alias("bucket"))
    path = shared_path(spark, "buckets")
    tables.write_buckets(rows.withColumn("item_id", -F.col("item_id")), path)
    tables.write_buckets(rows, path)
    return spark.read.schema(rows.schema).parquet(path).select("item_id", "bucket")


BENCH_LINE = {
    "bl": "SELECT l_orderkey * 10 + l_linenumber AS run, CASE l_linenumber % 3 WHEN 0 THEN 'Throughput: ' || l_quantity::INT || '.5 qps' WHEN 1 THEN 'Latency: min = 1 ms, mean = ' || l_quantity::INT || '.25 ms' ELSE 'Engine built in ' || l_quantity::INT || ' sec' END AS line FROM lineitem"
}
NUM = lambda p: f"nullif(regexp_extract(line, '{p}', 1), '')::DOUBLE"


@query("bench_log", sql("SELECT run, " + ", ".join(f"{NUM(ev.BENCH[n])} AS {n}" for n in ("throughput_qps", "latency_ms", "build_s", "size_mib")) + " FROM bl", **BENCH_LINE))
def bench_log(spark, sf):
    q = F.col("l_quantity").cast("int").cast("string")
    m = F.col("l_linenumber") % 3
    line = (
        F.when(m == 0, F.concat(F.lit("Throughput: "), q, F.lit(".5 qps")))
        .when(m == 1, F.concat(F.lit("Latency: min = 1 ms, mean = "), q, F.lit(".25 ms")))
        .otherwise(F.concat(F.lit("Engine built in "), q, F.lit(" sec")))
    )
    rows = src.table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("run"), line.alias("line"))
    numbers = ev.bench_numbers()
    return rows.select("run", *[numbers[n].alias(n) for n in ("throughput_qps", "latency_ms", "build_s", "size_mib")])


@query(
    "norm_constant",
    sql(
        f"SELECT phrase_id, frame::BIGINT AS frame, {v.rnd('abs(vals[3] - vals[2]) / 4')} AS c, CASE WHEN la >= 1.75 * ra THEN 'left' WHEN ra >= 1.75 * la THEN 'right' ELSE 'middle' END AS angle FROM "
        "(SELECT l.phrase_id, l.frame, list_sort([l.x15, l.x16, r.x15, r.x16]) AS vals, (l.bx2 - l.bx1) * (l.by2 - l.by1) AS la, (r.bx2 - r.bx1) * (r.by2 - r.by1) AS ra, row_number() OVER (PARTITION BY l.phrase_id ORDER BY l.frame) AS rk "
        "FROM boxed l JOIN boxed r ON l.phrase_id = r.phrase_id AND l.frame = r.frame AND l.side = 'left' AND r.side = 'right' WHERE l.x15 > 0 AND l.x16 > 0 AND r.x15 > 0 AND r.x16 > 0) WHERE rk = 1",
        "pixels", **BOXED,
    ),
)
def norm_constant(spark, sf):
    """First frame with all four feet: a quarter of the gap between the inner two."""
    b = boxed(spark, sf).where("x15 IS NOT NULL AND x16 IS NOT NULL")
    area = F.expr("(bx2 - bx1) * (by2 - by1)")
    pick = lambda s, c: F.max(F.when(F.col("side") == s, c))
    frames = b.select(*SIDE, "frame", "x15", "x16", area.alias("area")).groupBy("phrase_id", "frame").agg(
        *[pick(s, F.col(c)).alias(f"{s[0]}{c}") for s in ("left", "right") for c in ("x15", "x16", "area")], F.count("side").alias("n")
    )
    both = frames.where("n = 2")
    first = both.groupBy("phrase_id").agg(F.min(F.struct("frame", "lx15", "lx16", "rx15", "rx16", "larea", "rarea")).alias("f")).select("phrase_id", "f.*")
    feet = F.sort_array(F.array("lx15", "lx16", "rx15", "rx16"))
    l, r = F.col("larea"), F.col("rarea")
    return first.select(
        "phrase_id", big("frame").alias("frame"), rnd(F.abs(feet[2] - feet[1]) / 4).alias("c"),
        F.when(l >= 1.75 * r, "left").when(r >= 1.75 * l, "right").otherwise("middle").alias("angle"),
    )


@query("accuracy", sql(f"SELECT count(*) AS rows_total, count(label) AS rows_labelled, {v.rnd('avg((predicted = label)::INT)')} AS accuracy, {v.rnd('0.5 * (avg((predicted = label)::INT) FILTER (label = 1) + avg((predicted = label)::INT) FILTER (label = 0))')} AS balanced FROM predictions", "predictions"))
def accuracy(spark, sf):
    rows = ev.accuracy(src.predictions(spark, sf))
    return rows.select("rows_total", "rows_labelled", rnd("accuracy").alias("accuracy"), rnd("balanced").alias("balanced"))


@query("accuracy_by_confidence", sql(f"SELECT coalesce(confidence, 'all') AS confidence, count(*) AS n, {v.rnd('avg((predicted = label)::INT)')} AS accuracy FROM predictions GROUP BY ROLLUP (confidence)", "predictions"))
def accuracy_by_confidence(spark, sf):
    return ev.accuracy_by_tier(src.predictions(spark, sf)).select("confidence", "n", rnd("accuracy").alias("accuracy"))


VB = {"vb": "SELECT CASE WHEN predicted = label THEN 'correct' ELSE 'mismatch' END AS verdict, CASE WHEN confidence = 'high' THEN 'blade' ELSE 'no_blade' END AS contact FROM predictions"}


@query("validation_buckets", sql("SELECT coalesce(verdict, 'all') AS verdict, coalesce(contact, 'all') AS contact, count(*) AS n FROM vb GROUP BY GROUPING SETS ((verdict, contact), (verdict), ())", "predictions", **VB))
def validation_buckets(spark, sf):
    rows = src.predictions(spark, sf).select(
        F.when(F.col("predicted") == F.col("label"), "correct").otherwise("mismatch").alias("verdict"),
        F.when(F.col("confidence") == "high", "blade").otherwise("no_blade").alias("contact"),
    )
    return ev.validation_buckets(rows)


@query(
    "batch_status",
    sql(
        f"SELECT count(*) FILTER (status = 'ok') AS processed, count(*) FILTER (status = 'skipped_existing') AS skipped, count(*) FILTER (status = 'error') AS errors, {v.rnd('sum(seconds)', 2)} AS elapsed, arg_max(name, seq) FILTER (status = 'ok') AS last_completed FROM "
        "(SELECT o_orderkey AS seq, 'p' || o_orderkey AS name, CASE o_orderstatus WHEN 'F' THEN 'ok' WHEN 'O' THEN 'skipped_existing' ELSE 'error' END AS status, floor(o_totalprice) AS seconds FROM orders)"
    ),
)
def batch_status(spark, sf):
    s = F.col("o_orderstatus")
    log = src.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("seq"), F.concat(F.lit("p"), F.col("o_orderkey").cast("string")).alias("name"),
        F.when(s == "F", "ok").when(s == "O", "skipped_existing").otherwise("error").alias("status"), F.floor("o_totalprice").alias("seconds"),
    )
    return ev.batch_status(log).withColumn("elapsed", rnd("elapsed", 2))


SIDES_SQL = {"sp": "SELECT item_id, CASE label WHEN 1 THEN 'left' ELSE CASE WHEN item_id % 4 = 0 THEN 'abstain' ELSE 'right' END END AS label, CASE predicted WHEN 1 THEN 'left' ELSE CASE WHEN item_id % 7 = 0 THEN NULL ELSE 'right' END END AS predicted FROM predictions"}


def sided(spark, sf):
    i = F.col("item_id")
    return src.predictions(spark, sf).select(
        "item_id",
        F.when(F.col("label") == 1, "left").when(i % 4 == 0, "abstain").otherwise("right").alias("label"),
        F.when(F.col("predicted") == 1, "left").when(i % 7 != 0, "right").alias("predicted"),
    )


MATCH = "coalesce(CASE WHEN label = 'abstain' THEN predicted IN ('left', 'right', 'abstain') ELSE label = predicted END, false)"


@query("label_join", sql(f"SELECT item_id, {MATCH} AS matched FROM sp", "predictions", **SIDES_SQL))
def label_join(spark, sf):
    rows = sided(spark, sf)
    joined = rows.select("item_id", "predicted").join(rows.select("item_id", "label"), "item_id")
    return joined.select("item_id", ev.matches(F.col("label"), F.col("predicted")).alias("matched"))


@query("rule_accuracy", sql(f"SELECT {v.rnd(f'avg(({MATCH})::INT)')} AS accuracy FROM sp", "predictions", **SIDES_SQL))
def rule_accuracy(spark, sf):
    return sided(spark, sf).agg(rnd(ev.share(ev.matches(F.col("label"), F.col("predicted")))).alias("accuracy"))


@query(
    "class_report",
    sql(
        f"SELECT cls, {v.rnd('coalesce(hit / nullif(said, 0), 0)')} AS precision, {v.rnd('coalesce(hit / nullif(support, 0), 0)')} AS recall, {v.rnd('coalesce(2 * hit / nullif(said + support, 0), 0)')} AS f1, support FROM "
        "(SELECT cls, count(*) FILTER (label = cls) AS support, count(*) FILTER (predicted = cls) AS said, count(*) FILTER (label = cls AND predicted = cls) AS hit FROM predictions, (VALUES (0), (1)) c(cls) GROUP BY cls)".replace("c(cls)", "c(cls0)").replace("SELECT cls, count", "SELECT cls0::BIGINT AS cls, count").replace("= cls)", "= cls0)").replace("= cls AND", "= cls0 AND").replace("GROUP BY cls)", "GROUP BY cls0)"),
        "predictions",
    ),
)
def class_report(spark, sf):
    rows = ev.class_report(src.predictions(spark, sf))
    return rows.select("cls", *[rnd(c).alias(c) for c in ("precision", "recall", "f1")], "support")


# The two sides meet per frame; the joints are listed once after that.
BOTH_SIDES = ", ".join(f"{{'kp': {k}, 'lx': l.x{k}, 'ly': l.y{k}, 'rx': r.x{k}, 'ry': r.y{k}}}" for k in range(17))
ERR = {
    "sides": f"SELECT l.phrase_id, l.frame, unnest([{BOTH_SIDES}]) AS j FROM (SELECT * FROM poses WHERE side = 'left') l JOIN (SELECT * FROM poses WHERE side = 'right') r ON l.phrase_id = r.phrase_id AND l.frame = r.frame",
    "er": "SELECT phrase_id, frame, j.kp AS kp, sqrt(power(j.lx - j.rx, 2) + power(j.ly - j.ry, 2)) / 2.0 AS error FROM sides WHERE j.lx > 0 AND j.ly > 0 AND j.rx > 0 AND j.ry > 0",
}


def errors(spark, sf):
    """Left joints as the candidate, right joints as the reference."""
    rows = src.long_poses(src.poses(spark, sf))
    side = lambda s: rows.where(F.col("side") == s).drop("side")
    return ev.joint_errors(side("left"), side("right"), ["phrase_id", "frame", "kp"], 2.0)


@query("oracle_compare", sql(f"SELECT phrase_id, frame, kp::BIGINT AS kp, {v.rnd('error')} AS error FROM er", "poses", **ERR))
def oracle_compare(spark, sf):
    return errors(spark, sf).select("phrase_id", "frame", big("kp").alias("kp"), rnd("error").alias("error"))


@query(
    "pck_metrics",
    sql(f"SELECT kp::BIGINT AS kp, {v.rnd('avg((error <= 0.05)::INT)')} AS pck_05, {v.rnd('avg((error <= 0.10)::INT)')} AS pck_10, {v.rnd('avg(error)')} AS mean_error, count(*) AS n FROM er GROUP BY kp", "poses", **ERR),
)
def pck_metrics(spark, sf):
    return ev.pck(errors(spark, sf)).select(big("kp").alias("kp"), *[rnd(c).alias(c) for c in ("pck_05", "pck_10", "mean_error")], "n")


@query("pck_groups", sql(f"SELECT CASE WHEN kp IN (7, 8) THEN 'elbows' WHEN kp IN (9, 10) THEN 'wrists' WHEN kp IN (13, 14) THEN 'knees' ELSE 'ankles' END AS joint_group, {v.rnd('avg(error)')} AS mean_error, count(*) AS n FROM er WHERE kp IN (7, 8, 9, 10, 13, 14, 15, 16) GROUP BY 1", "poses", **ERR))
def pck_groups(spark, sf):
    return ev.group_errors(errors(spark, sf)).withColumn("mean_error", rnd("mean_error"))


@query("model_summary", sql(f"SELECT model, count(*) AS phrases, {v.rnd('avg(CASE WHEN n = 3 THEN 0 ELSE seconds END)')} AS mean_seconds, {v.rnd('avg(frames) / avg(CASE WHEN n = 3 THEN 0 ELSE seconds END)')} AS fps FROM runs GROUP BY model", "runs"))
def model_summary(spark, sf):
    runs = src.bench_runs(spark, sf).withColumn("seconds", F.when(F.col("n") != 3, F.col("seconds")))
    return ev.model_summary(runs).select("model", "phrases", rnd("mean_seconds").alias("mean_seconds"), rnd("fps").alias("fps"))


@query(
    "detection_stats",
    sql(f"SELECT model, count(*) AS frames, count(*) FILTER (people > 0) AS nonzero, {v.rnd('avg(people)')} AS mean_people, max(people) AS max_people FROM (SELECT model, phrase AS frame, count(*) FILTER (n <> 1) AS people FROM runs GROUP BY model, phrase) GROUP BY model", "runs"),
)
def detection_stats(spark, sf):
    rows = src.bench_runs(spark, sf).select("model", F.col("phrase").alias("frame"), F.when(F.col("n") != 1, F.col("n")).alias("person"))
    return ev.detection_stats(rows, ["model"]).withColumn("mean_people", rnd("mean_people"))


@query("sorted_output", sql("SELECT item_id, predicted, confidence FROM predictions ORDER BY item_id", "predictions"))
def sorted_output(spark, sf):
    return src.predictions(spark, sf).select("item_id", "predicted", "confidence").orderBy("item_id")


FEATURES = list(g.ANGLES) + list(g.RATIOS)


@query(
    "feature_intersect",
    sql(
        "SELECT phrase_id, frame, (" + " + ".join(f"(l.{c} IS NOT NULL AND r.{c} IS NOT NULL)::INT" for c in [f"a{i}" for i in range(10)] + [f"r{i}" for i in range(10)]) + ")::BIGINT AS shared, (20 - ("
        + " + ".join(f"(l.{c} IS NOT NULL)::INT" for c in [f"a{i}" for i in range(10)] + [f"r{i}" for i in range(10)]) + "))::BIGINT AS missing_left FROM (SELECT * FROM d WHERE side = 'left') l JOIN (SELECT * FROM d WHERE side = 'right') r USING (phrase_id, frame)",
        "poses", d=f"SELECT phrase_id, side, frame, {v.descriptor()} FROM poses",
    ),
)
def feature_intersect(spark, sf):
    """Features defined on both sides, and features missing on the left."""
    rows = g.with_descriptor(g.only_valid(src.poses(spark, sf)))
    cols = [f"a{i}" for i in range(10)] + [f"r{i}" for i in range(10)]
    names = F.array_compact(F.array(*[F.expr(f"CASE WHEN {c} IS NOT NULL THEN '{n}' END") for c, n in zip(cols, FEATURES)]))
    rows = rows.select(*SIDE, "frame", names.alias("names"))
    side = lambda s: rows.where(F.col("side") == s).select("phrase_id", "frame", F.col("names").alias(s))
    both = side("left").join(side("right"), ["phrase_id", "frame"])
    every = F.array(*[F.lit(n) for n in FEATURES])
    return both.select(
        "phrase_id", "frame", big(F.size(F.array_intersect("left", "right"))).alias("shared"), big(F.size(F.array_except(every, "left"))).alias("missing_left")
    )


@query(
    "reference_lookup",
    sql(
        "SELECT phrase_id, side, frame, kp::BIGINT AS kp, name, CASE side WHEN 'left' THEN 'A' ELSE 'B' END AS box_side FROM joints JOIN (VALUES " + ", ".join(f"({k}, '{n}')" for k, n in tables.JOINT_NAMES.items()) + ") n(kp, name) USING (kp) WHERE x IS NOT NULL",
        "joints",
    ),
)
def reference_lookup(spark, sf):
    """Joint names and box sides joined to facts; both tables have a fixed size."""
    names = spark.createDataFrame(list(tables.JOINT_NAMES.items()), "kp int, name string")
    sides = spark.createDataFrame([(s, ab) for ab, s in codes.SIDE_MAP.items()], "side string, box_side string")
    rows = src.long_poses(src.poses(spark, sf)).where("x IS NOT NULL").drop("x", "y")
    return rows.join(F.broadcast(names), "kp").join(F.broadcast(sides), "side").withColumn("kp", big("kp"))
