"""Queries of the workbench operators and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import workbench as wb
from .views import APPS, applications, read, typed

QUERIES, ORACLE = {}, {}


def query(sql: str | None):
    """Registers a function under its name, with its oracle if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query(f"""WITH {APPS}, q AS (SELECT DISTINCT quotation_id, code_id FROM apps), d AS (SELECT DISTINCT document_id, code_id FROM apps),
n AS (SELECT code_id, count(*) AS n FROM apps GROUP BY 1),
qp AS (SELECT x.code_id AS a, y.code_id AS b, count(*) AS quotations FROM q x JOIN q y ON x.quotation_id = y.quotation_id AND x.code_id < y.code_id GROUP BY 1, 2),
dp AS (SELECT x.code_id AS a, y.code_id AS b, count(*) AS documents FROM d x JOIN d y ON x.document_id = y.document_id AND x.code_id < y.code_id GROUP BY 1, 2),
m AS (SELECT coalesce(qp.a, dp.a) AS a, coalesce(qp.b, dp.b) AS b, coalesce(quotations, 0) AS quotations, coalesce(documents, 0) AS documents
  FROM qp FULL JOIN dp ON qp.a = dp.a AND qp.b = dp.b)
SELECT a, b, quotations, documents, round(quotations / (x.n + y.n - quotations)::DOUBLE, 6) AS c
FROM m JOIN n x ON a = x.code_id JOIN n y ON b = y.code_id WHERE quotations >= 1 OR documents >= 2
ORDER BY quotations DESC, documents DESC, a, b LIMIT 200""")
def code_cooccurrence(spark, sf):
    return wb.co_occurrence(applications(spark, sf))


_LINKS = "links AS (SELECT DISTINCT p_brand AS src, p_type AS dst FROM part)"


def _links(spark, sf):
    return read(spark, sf, "part").select(F.col("p_brand").alias("src"), F.col("p_type").alias("dst")).distinct()


@query(f"""WITH {APPS}, {_LINKS}, ends AS (SELECT src AS code_id FROM links UNION ALL SELECT dst FROM links WHERE src <> dst),
dens AS (SELECT code_id, count(*) AS density FROM ends GROUP BY 1),
memo AS (SELECT p_brand AS code_id, count(*) AS memos FROM part WHERE p_size > 40 GROUP BY 1),
grp AS (SELECT code_id, string_agg(g, ',' ORDER BY g) AS groups FROM (SELECT DISTINCT p_brand AS code_id, p_type AS g FROM part WHERE p_size < 4) GROUP BY 1),
base AS (SELECT code_id, count(*) AS groundedness, count(DISTINCT document_id) AS documents FROM apps GROUP BY 1)
SELECT code_id, groundedness, documents, coalesce(density, 0) AS density, coalesce(memos, 0) AS memos, coalesce(groups, '') AS groups
FROM base LEFT JOIN dens USING (code_id) LEFT JOIN memo USING (code_id) LEFT JOIN grp USING (code_id)""")
def codebook_stats(spark, sf):
    part = read(spark, sf, "part")
    memos = part.where("p_size > 40").select(F.col("p_brand").alias("code_id"))
    groups = part.where("p_size < 4").select(F.col("p_brand").alias("code_id"), F.col("p_type").alias("group"))
    return wb.codebook_stats(applications(spark, sf), _links(spark, sf), groups, memos)


_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query(f"""WITH {APPS}, t AS (SELECT code_id, c_mktsegment AS d FROM apps JOIN customer ON document_id = c_custkey)
SELECT code_id, {", ".join(f"count(*) FILTER (d = '{s}') AS {s}" for s in _SEGMENTS)}, count(*) FILTER (d IN ({", ".join(repr(s) for s in _SEGMENTS)})) AS total,
count(DISTINCT d) FILTER (d IN ({", ".join(repr(s) for s in _SEGMENTS)})) AS n_documents FROM t GROUP BY 1""")
def code_document_matrix(spark, sf):
    customer = read(spark, sf, "customer").select(F.col("c_custkey").alias("document_id"), F.col("c_mktsegment").alias("document"))
    return wb.code_document_table(applications(spark, sf).join(customer, "document_id"), _SEGMENTS)


_CODES = ["Brand#11", "Brand#23"]
_LIST = "('Brand#11', 'Brand#23')"


def _retrieval(operator: str, test: str, scope: str = "quotation"):
    key = f"{scope}_id"
    sql = f"""WITH {APPS}, k AS (SELECT {key}, count(DISTINCT CASE WHEN code_id IN {_LIST} THEN code_id END) AS m, count(DISTINCT code_id) AS t FROM apps GROUP BY 1)
SELECT DISTINCT document_id, quotation_id FROM apps JOIN k USING ({key}) WHERE {test}"""

    def run(spark, sf):
        return wb.retrieve(applications(spark, sf), _CODES, operator, scope)

    run.__name__ = f"retrieve_{operator}" if scope == "quotation" else f"retrieve_document_scope_{operator}"
    query(sql)(run)


for _op, _test in (("all", "m = 2"), ("any", "m > 0"), ("none", "m = 0"), ("only", "m = 2 AND t = 2")):
    _retrieval(_op, _test)
_retrieval("all", "m = 2", "document")

_PAIRS = f"""{APPS}, sets AS (SELECT quotation_id, list_sort(list_distinct(list(code_id) FILTER (created_by = 'user'))) AS human,
  list_sort(list_distinct(list(code_id) FILTER (created_by <> 'user'))) AS machine FROM
  (SELECT quotation_id, code_id, CASE WHEN line % 2 = 0 THEN 'user' ELSE 'auto' END AS created_by FROM apps) GROUP BY 1),
pairs AS (SELECT *, human[1] AS h, machine[1] AS m FROM sets WHERE len(human) > 0 AND len(machine) > 0)"""


def _pairs(spark, sf):
    """Every other line of an order counts as coded by hand."""
    coder = F.when(F.col("line") % 2 == 0, "user").otherwise("auto")
    return wb.agreement_pairs(applications(spark, sf).withColumn("created_by", coder))


@query(f"""WITH {_PAIRS} SELECT count(*) AS n, count(*) FILTER (human = machine) AS exact, count(*) FILTER (list_has_any(human, machine)) AS partial,
round(count(*) FILTER (human = machine) / count(*)::DOUBLE, 6) AS percent, round(count(*) FILTER (list_has_any(human, machine)) / count(*)::DOUBLE, 6) AS partial_percent FROM pairs""")
def agreement_percent(spark, sf):
    return wb.percent_agreement(_pairs(spark, sf))


_KAPPA = """a AS (SELECT h AS label, count(*) AS na FROM pairs GROUP BY 1), b AS (SELECT m AS label, count(*) AS nb FROM pairs GROUP BY 1),
x AS (SELECT count(*) AS labels, sum(coalesce(na, 0) * coalesce(nb, 0))::DOUBLE AS cross_n FROM a FULL JOIN b USING (label)),
s AS (SELECT count(*) AS n, count(*) FILTER (h = m) AS agree FROM pairs)
SELECT n, labels, CASE WHEN labels >= 2 AND cross_n / (n * n) < 1 THEN round((agree / n::DOUBLE - cross_n / (n * n)) / (1 - cross_n / (n * n)), 6) END AS kappa FROM s, x"""
_ALPHA = """u AS (SELECT label, count(*) AS n FROM (SELECT h AS label FROM pairs UNION ALL SELECT m FROM pairs) GROUP BY 1),
s AS (SELECT sum(n)::DOUBLE AS total, sum(n * n)::DOUBLE AS squares FROM u), o AS (SELECT count(*) AS pairs, count(*) FILTER (h <> m) AS differ FROM pairs)
SELECT pairs, CASE WHEN pairs < 2 THEN NULL WHEN total * total = squares THEN 1.0
ELSE round(1 - differ / pairs::DOUBLE / ((total * total - squares) / total / (total - 1)), 6) END AS alpha FROM o, s"""
_LABELS = "pairs AS (SELECT quality AS h, toxic AS m FROM labels)"


@query(f"WITH {_PAIRS}, {_KAPPA}")
def cohens_kappa(spark, sf):
    return wb.cohens_kappa(_pairs(spark, sf))


@query(f"WITH {_LABELS}, {_KAPPA}")
def cohens_kappa_labels(spark, sf):
    return wb.cohens_kappa(read(spark, sf, "labels"), "quality", "toxic")


@query(f"WITH {_PAIRS}, {_ALPHA}")
def krippendorff_alpha(spark, sf):
    return wb.krippendorff_alpha(_pairs(spark, sf))


@query(f"WITH {_LABELS}, {_ALPHA}")
def krippendorff_alpha_labels(spark, sf):
    return wb.krippendorff_alpha(read(spark, sf, "labels"), "quality", "toxic")


@query("""SELECT s_suppkey, CASE WHEN a >= 0.8 THEN 'reliable' WHEN a >= 0.667 THEN 'tentative' ELSE 'unreliable' END
|| CASE WHEN s_suppkey < 20 THEN ' (few units)' ELSE '' END AS band FROM (SELECT s_suppkey, s_acctbal / 10000 AS a FROM supplier)""")
def agreement_bands(spark, sf):
    return read(spark, sf, "supplier").select("s_suppkey", wb.agreement_band(F.col("s_acctbal") / 10000, F.col("s_suppkey")).alias("band"))


_MAP = "mp AS (SELECT * FROM (VALUES ('Brand#11', 'Brand#12'), ('Brand#13', 'Brand#12')) t(code_id, keep_id))"


def _mapping(spark):
    return spark.createDataFrame([("Brand#11", "Brand#12"), ("Brand#13", "Brand#12")], "code_id string, keep_id string")


@query(f"""WITH {APPS}, {_MAP}, r AS (SELECT DISTINCT quotation_id, coalesce(keep_id, apps.code_id) AS code_id FROM apps LEFT JOIN mp USING (code_id))
SELECT code_id, count(*) AS quotations FROM r GROUP BY 1""")
def merge_codes(spark, sf):
    apps, _ = wb.merge_codes(applications(spark, sf), _links(spark, sf), _mapping(spark))
    return apps.groupBy("code_id").agg(F.count("*").alias("quotations"))


@query(f"""WITH {_LINKS}, {_MAP} SELECT DISTINCT coalesce(x.keep_id, src) AS src, coalesce(y.keep_id, dst) AS dst
FROM links LEFT JOIN mp x ON src = x.code_id LEFT JOIN mp y ON dst = y.code_id WHERE coalesce(x.keep_id, src) <> coalesce(y.keep_id, dst)""")
def merge_links(spark, sf):
    return wb.merge_codes(applications(spark, sf), _links(spark, sf), _mapping(spark))[1]


@query(f"WITH {APPS} SELECT code_id, count(*) AS n FROM apps WHERE code_id NOT IN {_LIST} GROUP BY 1")
def delete_code_cascade(spark, sf):
    gone = spark.createDataFrame([(c,) for c in _CODES], "code_id string")
    return wb.delete_codes(applications(spark, sf), gone).groupBy("code_id").agg(F.count("*").alias("n"))


@query(f"""WITH {APPS}, kept AS (SELECT quotation_id FROM apps WHERE created_by = 'user')
SELECT DISTINCT quotation_id, created_by FROM apps WHERE created_by <> 'user' AND quotation_id NOT IN (SELECT quotation_id FROM kept)""")
def retention_anti_join(spark, sf):
    apps = applications(spark, sf)
    return wb.unreferenced(apps.select("quotation_id", "created_by").distinct(), wb.retained(apps))


@query(f"""WITH {APPS}, old AS (SELECT DISTINCT quotation_id, code_id FROM apps WHERE line <= 3),
new AS (SELECT DISTINCT quotation_id, code_id FROM apps), u AS (SELECT * FROM old UNION ALL SELECT * FROM new ANTI JOIN old USING (quotation_id, code_id))
SELECT quotation_id, count(*) AS codes FROM u GROUP BY 1""")
def apply_codes_idempotent(spark, sf):
    pairs = applications(spark, sf).select("quotation_id", "code_id", "line")
    old = pairs.where("line <= 3").drop("line").distinct()
    return wb.apply_codes(old, pairs.drop("line")).groupBy("quotation_id").agg(F.count("*").alias("codes"))


_SPANS = """spans AS (SELECT l_orderkey AS document_id, CAST(l_quantity AS INTEGER) * 7 - 40 AS "start", CAST(l_quantity AS INTEGER) * 9 AS "end" FROM lineitem),
lens AS (SELECT o_orderkey AS document_id, CAST(o_totalprice AS INTEGER) % 400 AS length FROM orders)"""


def _spans(spark, sf):
    q = F.col("l_quantity").cast("int")
    return (
        read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("document_id"), (q * 7 - 40).alias("start"), (q * 9).alias("end")),
        read(spark, sf, "orders").select(F.col("o_orderkey").alias("document_id"), (F.round("o_totalprice").cast("int") % 400).alias("length")),
    )


_CLAMPED = """c AS (SELECT document_id, least(greatest("start", 0), length) AS "start", least(greatest("end", 0), length) AS "end" FROM spans JOIN lens USING (document_id)),
made AS (SELECT DISTINCT * FROM c WHERE "end" - "start" >= 2)"""


@query(f'WITH {_SPANS}, {_CLAMPED} SELECT * FROM made'.replace("CAST(o_totalprice AS INTEGER)", "CAST(round(o_totalprice) AS INTEGER)"))
def create_quotations(spark, sf):
    return wb.create_quotations(*_spans(spark, sf))


@query(f"""WITH {_SPANS}, {_CLAMPED} SELECT document_id, "start", "end", CASE WHEN document_id % 3 = 0 THEN 'q' || document_id
ELSE sha256(document_id || ':' || "start" || ':' || "end") END AS quotation_id FROM made""".replace("CAST(o_totalprice AS INTEGER)", "CAST(round(o_totalprice) AS INTEGER)"))
def reuse_spans(spark, sf):
    made = wb.create_quotations(*_spans(spark, sf))
    known = made.where("document_id % 3 = 0").withColumn("quotation_id", F.concat(F.lit("q"), F.col("document_id").cast("string")))
    return wb.reuse_spans(made, known)


@query(f"""WITH {APPS}, m AS (SELECT CASE WHEN theme_id IN ('ECONOMY', 'PROMO') THEN 'ECONOMY' ELSE theme_id END AS theme_id, theme_id IN ('ECONOMY', 'PROMO') AS t, confidence, document_id FROM apps)
SELECT theme_id, count(*) AS members, round(avg(confidence), 6) AS confidence, count(DISTINCT document_id) AS documents,
round(count(*) / sum(count(*)) OVER ()::DOUBLE, 6) AS coverage, CASE WHEN bool_or(t) THEN 'review' ELSE 'confirmed' END AS status FROM m GROUP BY 1""")
def theme_merge_recompute(spark, sf):
    mapping = spark.createDataFrame([("ECONOMY", "ECONOMY"), ("PROMO", "ECONOMY")], "theme_id string, to string")
    return wb.recompute_themes(applications(spark, sf), mapping)


@query(f"""WITH {APPS}, m AS (SELECT CASE WHEN theme_id = 'ECONOMY' AND quantity > 25 THEN 'ECONOMY (split)' ELSE theme_id END AS theme_id, confidence, document_id FROM apps)
SELECT theme_id, count(*) AS members, round(avg(confidence), 6) AS confidence, count(DISTINCT document_id) AS documents FROM m GROUP BY 1""")
def theme_split(spark, sf):
    moved = F.when((F.col("theme_id") == "ECONOMY") & (F.col("quantity") > 25), "ECONOMY (split)").otherwise(F.col("theme_id"))
    none = spark.createDataFrame([], "theme_id string, to string")
    return wb.recompute_themes(applications(spark, sf).withColumn("theme_id", moved), none).drop("coverage", "status")


@query("""WITH links AS (SELECT DISTINCT l_suppkey AS src, l_suppkey + 5 AS dst FROM lineitem),
n AS (SELECT s_suppkey AS id, s_name AS name FROM supplier)
SELECT src, dst, coalesce(a.name, '(removed)') AS src_name, coalesce(b.name, '(removed)') AS dst_name FROM links LEFT JOIN n a ON src = a.id LEFT JOIN n b ON dst = b.id""")
def resolve_links(spark, sf):
    links = read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_suppkey") + 5).alias("dst")).distinct()
    return wb.resolve_links(links, read(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")))


@query(f"""WITH {APPS}, c AS (SELECT quotation_id, string_agg(code_id, ',' ORDER BY code_id) AS codes FROM (SELECT DISTINCT quotation_id, code_id FROM apps) GROUP BY 1)
SELECT o_orderkey AS quotation_id, coalesce(codes, '') AS codes FROM orders LEFT JOIN c ON o_orderkey = quotation_id""")
def hydrate_quotations(spark, sf):
    return wb.hydrate(read(spark, sf, "orders").select(F.col("o_orderkey").alias("quotation_id")), applications(spark, sf))


@query("""WITH e AS (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000)
SELECT event_type, count(*) AS calls, round(sum(value), 4) AS cost, sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS tokens,
count(*) FILTER (value < 10) AS failures FROM e GROUP BY 1""")
def usage_ledger(spark, sf):
    events = read(spark, sf, "events")
    return wb.usage_ledger(events.withColumn("k", F.get_json_object("props", "$.k").cast("bigint")))


@query("SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 300")
def audit_tail(spark, sf):
    return read(spark, sf, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(300).select("event_id", "user_id", "event_type")


@query(f"""WITH {APPS} SELECT count(DISTINCT document_id) AS documents, count(DISTINCT quotation_id) AS quotations, count(DISTINCT code_id) AS codes,
count(*) AS applications, count(*) FILTER (created_by = 'user') AS by_hand, count(DISTINCT theme_id) AS themes FROM apps""")
def overview_counters(spark, sf):
    distinct = {"documents": "document_id", "quotations": "quotation_id", "codes": "code_id", "themes": "theme_id"}
    return applications(spark, sf).agg(
        *[F.count_distinct(c).alias(n) for n, c in distinct.items()], F.count("*").alias("applications"), F.count_if(F.col("created_by") == "user").alias("by_hand")
    )


@query("""SELECT c_nationkey AS project, count(DISTINCT c_custkey) AS documents, count(o_orderkey) AS quotations,
(SELECT count(*) FROM supplier WHERE s_nationkey = c_nationkey) AS memos FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def project_counts(spark, sf):
    customer, orders, supplier = (read(spark, sf, t) for t in ("customer", "orders", "supplier"))
    counts = (
        customer.select(F.col("c_nationkey").alias("project"), F.lit("documents").alias("what"))
        .unionByName(customer.join(orders, F.col("c_custkey") == F.col("o_custkey")).select(F.col("c_nationkey").alias("project"), F.lit("quotations").alias("what")))
        .unionByName(supplier.join(customer.select(F.col("c_nationkey").alias("s_nationkey")).distinct(), "s_nationkey").select(F.col("s_nationkey").alias("project"), F.lit("memos").alias("what")))
    )
    return counts.groupBy("project").pivot("what", ["documents", "quotations", "memos"]).agg(F.count(F.lit(1))).fillna(0)


@query("""SELECT event_id, least(greatest(coalesce(TRY_CAST(CASE WHEN event_id % 5 = 0 THEN 'x' ELSE CAST(event_id % 40 AS VARCHAR) END AS DOUBLE), 0.28), 2.0), 30.0) AS control FROM events""")
def clamp_controls(spark, sf):
    raw = F.when(F.col("event_id") % 5 == 0, "x").otherwise((F.col("event_id") % 40).cast("string"))
    return read(spark, sf, "events").select("event_id", wb.clamp(raw, 0.28, 2.0, 30.0).alias("control"))


@query("""SELECT s_suppkey, (s_suppkey + list_sum(list_transform(string_split(s_name, ''), lambda c: ascii(c)))) % 12 AS colour FROM supplier""")
def code_colours(spark, sf):
    return read(spark, sf, "supplier").select("s_suppkey", wb.colour_for(F.col("s_name"), F.col("s_suppkey")).alias("colour"))


@query("SELECT p_partkey, p_name FROM part WHERE lower(p_brand) = lower('BRAND#23')")
def code_lookup(spark, sf):
    return read(spark, sf, "part").where(F.lower("p_brand") == F.lower(F.lit("BRAND#23"))).select("p_partkey", "p_name")


@query("""(SELECT 'code' AS kind, p_brand AS id FROM part GROUP BY 2) UNION ALL (SELECT 'document', CAST(c_custkey AS VARCHAR) FROM customer)
UNION ALL (SELECT 'quotation', CAST(o_orderkey AS VARCHAR) FROM (SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 120))""")
def link_targets(spark, sf):
    latest = read(spark, sf, "orders").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(120)
    kind = lambda df, name, c: df.select(F.lit(name).alias("kind"), F.col(c).cast("string").alias("id"))
    return (
        kind(read(spark, sf, "part").select("p_brand").distinct(), "code", "p_brand")
        .unionByName(kind(read(spark, sf, "customer"), "document", "c_custkey")).unionByName(kind(latest, "quotation", "o_orderkey"))
    )


typed(ORACLE, {"code_document_matrix": {"n_documents": "INTEGER"}, "usage_ledger": {"tokens": "BIGINT"}, "code_colours": {"colour": "BIGINT"}})
