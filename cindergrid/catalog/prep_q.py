"""Queries of preprocessing fit and transform (H1-H7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cindergrid.catalog.base import query
from cindergrid.operators import prep

# customers: numeric balance with gaps, segment category, label by nation
CUST = """cu AS (SELECT c_custkey AS id, CASE WHEN c_custkey%13=0 THEN NULL ELSE c_acctbal END AS balance,
    CASE WHEN c_custkey%17=0 THEN NULL ELSE c_mktsegment END AS segment, c_custkey%5<>0 AS train, CASE WHEN c_nationkey<8 THEN 1 ELSE 0 END AS y FROM customer)"""


def _customers(t):
    k = F.col("c_custkey")
    return t.table("customer").select(
        k.alias("id"), F.when(F.pmod(k, F.lit(13)) != 0, F.col("c_acctbal")).alias("balance"),
        F.when(F.pmod(k, F.lit(17)) != 0, F.col("c_mktsegment")).alias("segment"),
        (F.pmod(k, F.lit(5)) != 0).alias("train"),
        (F.col("c_nationkey") < 8).cast("int").alias("y"),
    )


_FIT = """md AS (SELECT MEDIAN(balance) AS md FROM cu WHERE train),
  ms AS (SELECT md, AVG(COALESCE(balance,md)) AS m, {std}(COALESCE(balance,md)) AS s FROM cu, md WHERE train GROUP BY md)"""


@query(
    "h1_impute_standardise", "id:i balance:d8 segment_code:i",
    CUST + "," + _FIT.format(std="STDDEV_SAMP") + """, co AS (SELECT segment, ROW_NUMBER() OVER (ORDER BY MIN(id))-1 AS code FROM cu
        WHERE train AND segment IS NOT NULL AND segment<>'MACHINERY' GROUP BY 1)
      SELECT id, (COALESCE(balance,md)-m)/s AS balance, COALESCE(code,-1) AS segment_code FROM cu CROSS JOIN ms LEFT JOIN co USING (segment)""",
)
def h1(t):
    cu = _customers(t)
    train = cu.filter("train")
    stats = prep.numeric_statistics(train, ["balance"])
    # a category the training rows never show
    codes = prep.ordinal_codes(train.filter("segment <> 'MACHINERY'"), "segment", "id")
    scaled = prep.impute_and_scale(cu, stats, ["balance"])
    return prep.encode_ordinal(scaled, codes, "segment")


@query(
    "h2_numeric_block", "id:i balance:d8 balance_missing:i",
    CUST + "," + _FIT.format(std="STDDEV_POP") + """SELECT id, (COALESCE(balance,md)-m)/s AS balance,
      CASE WHEN balance IS NULL THEN 1 ELSE 0 END AS balance_missing FROM cu, ms""",
)
def h2(t):
    cu = _customers(t)
    stats = prep.numeric_statistics(cu.filter("train"), ["balance"], ddof=0)
    return prep.impute_and_scale(cu, stats, ["balance"], indicators=True)


@query(
    "h3_categorical_block", "id:i segment_code:i ones:i width:i hot:i id2_code:i",
    CUST + """, f AS (SELECT *, COALESCE(segment,'missing') AS sg, CAST(id%40 AS VARCHAR) AS i2 FROM cu),
      a AS (SELECT sg, ROW_NUMBER() OVER (ORDER BY MIN(id))-1 AS code FROM f WHERE train AND sg<>'FURNITURE' GROUP BY 1),
      b AS (SELECT i2, ROW_NUMBER() OVER (ORDER BY MIN(id))-1 AS code FROM f WHERE train AND sg<>'FURNITURE' GROUP BY 1)
      SELECT id, COALESCE(a.code,-1) AS segment_code, CASE WHEN a.code IS NULL THEN 0 ELSE 1 END AS ones, (SELECT COUNT(*) FROM a) AS width,
       COALESCE(a.code+1,0) AS hot, COALESCE(b.code,-1) AS id2_code FROM f LEFT JOIN a USING (sg) LEFT JOIN b USING (i2)""",
)
def h3(t):
    cu = _customers(t).withColumn("id2", F.pmod("id", F.lit(40)).cast("string"))
    train = cu.filter("train and (segment <> 'FURNITURE' or segment is null)")
    out = prep.categorical_block(train, cu, ["segment", "id2"], "id")
    hot = F.col("segment_onehot")
    return out.withColumns(
        {
            "ones": F.aggregate(hot, F.lit(0), lambda a, x: a + x), "width": F.size(hot),
            "hot": F.array_position(hot, 1),
        }
    )


@query(
    "h4_target_encoding", "id:i encoded:d9",
    CUST + """, g AS (SELECT AVG(y) AS g FROM cu WHERE train),
      e AS (SELECT segment, (SUM(y)+20*MAX(g))/(COUNT(*)+20) AS e FROM cu, g WHERE train AND segment<>'MACHINERY' GROUP BY 1)
      SELECT id, COALESCE(e,g2) AS encoded FROM cu CROSS JOIN (SELECT AVG(y) AS g2 FROM cu WHERE train AND segment<>'MACHINERY') z
      LEFT JOIN (SELECT segment, (SUM(y)+20*MAX(gg))/(COUNT(*)+20) AS e FROM cu, (SELECT AVG(y) AS gg FROM cu WHERE train AND segment<>'MACHINERY') q
        WHERE train AND segment<>'MACHINERY' GROUP BY 1) f USING (segment)""",
)
def h4(t):
    cu = _customers(t)
    train = cu.filter("train and segment <> 'MACHINERY'")
    return prep.encode_target(train, cu, "segment", "y")


_SER = """se AS (SELECT l_orderkey AS id, l_orderkey%4<>0 AS train, LIST(CASE WHEN l_quantity<5 THEN NULL ELSE l_quantity END ORDER BY
     md5(CONCAT_WS(':', CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(CAST(l_quantity AS INT) AS VARCHAR)))) AS s FROM lineitem GROUP BY 1,2),
   fl AS (SELECT id, train, UNNEST(s) AS v, UNNEST(range(len(s))) AS pos FROM se),
   md AS (SELECT pos, MEDIAN(v) AS md FROM fl WHERE train GROUP BY 1),
   st AS (SELECT pos, md, AVG(COALESCE(v,md)) AS m, STDDEV_POP(COALESCE(v,md)) AS sd FROM fl JOIN md USING (pos) WHERE train GROUP BY 1,2)"""


@query(
    "h5_channel_scaler", "id:i days:i first:d8 total:d6",
    _SER + """, x AS (SELECT id, pos, (COALESCE(v,md)-m)/CASE WHEN sd>0 THEN sd ELSE 1 END AS z FROM fl LEFT JOIN st USING (pos))
      SELECT id, COUNT(*) AS days, MAX(z) FILTER (pos=0) AS first, SUM(z) AS total FROM x GROUP BY 1""",
)
def h5(t):
    order = F.md5(
        F.concat_ws(
            ":", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"),
            F.col("l_linenumber").cast("string"), F.col("l_quantity").cast("int").cast("string"),
        )
    )
    value = F.when(F.col("l_quantity") >= 5, F.col("l_quantity"))
    rows = t.table("lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(
        F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v")))).alias("p")
    ).select("id", F.transform("p", lambda p: p["v"]).alias("series"))
    train = rows.filter(F.pmod("id", F.lit(4)) != 0)
    out = prep.scale_channel(rows, prep.channel_statistics(train))
    # a position that no training series reaches has no statistics and no part in the total
    known = F.filter("scaled", lambda x: x.isNotNull())
    return out.withColumns(
        {
            "days": F.size("scaled"), "first": F.element_at("scaled", 1),
            "total": F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, x: a + x)),
        }
    )


@query(
    "h6_weighted_standardiser", "column_name mean:d9 std:d8",
    """x AS (SELECT prob_raw AS a, CAST(lat_key AS DOUBLE) AS b, eval_weight AS w FROM predictions)
       SELECT 'a' AS column_name, SUM(w*a)/SUM(w) AS mean, SQRT(SUM(w*a*a)/SUM(w)-POWER(SUM(w*a)/SUM(w),2)) AS std FROM x UNION ALL
       SELECT 'b', SUM(w*b)/SUM(w), SQRT(SUM(w*b*b)/SUM(w)-POWER(SUM(w*b)/SUM(w),2)) FROM x""",
    "predictions",
)
def h6(t):
    x = t.predictions.select(
        F.col("prob_raw").alias("a"), F.col("lat_key").cast("double").alias("b"), "eval_weight"
    )
    return prep.weighted_statistics(x, ["a", "b"]).withColumnRenamed("column", "column_name")


@query(
    "h6_back_transform", "column_name coefficient:d8 intercept:d6",
    """x AS (SELECT prob_raw AS a, CAST(lat_key AS DOUBLE) AS b, eval_weight AS w FROM predictions),
       s AS (SELECT 'a' AS c, SUM(w*a)/SUM(w) AS m, SQRT(SUM(w*a*a)/SUM(w)-POWER(SUM(w*a)/SUM(w),2)) AS s FROM x UNION ALL
         SELECT 'b', SUM(w*b)/SUM(w), SQRT(SUM(w*b*b)/SUM(w)-POWER(SUM(w*b)/SUM(w),2)) FROM x),
       o AS (SELECT c, (s*2)/s AS co, m FROM s)
       SELECT c AS column_name, co AS coefficient, 1.5E0-SUM(co*m) OVER () AS intercept FROM o""",
    "predictions",
)
def h6_back(t):
    x = t.predictions.select(
        F.col("prob_raw").alias("a"), F.col("lat_key").cast("double").alias("b"), "eval_weight"
    )
    stats = prep.weighted_statistics(x, ["a", "b"])
    coefficients = stats.select("column", (F.col("std") * 2).alias("coefficient"))
    return prep.back_transform(coefficients, stats, 1.5).withColumnRenamed("column", "column_name")


@query(
    "h7_log_population", "id:i population:d9",
    "SELECT p_partkey AS id, LN(1+GREATEST(CAST(p_size-10 AS DOUBLE),0)) AS population FROM part",
)
def h7(t):
    p = t.table("part").select(F.col("p_partkey").alias("id"), (F.col("p_size") - 10).alias("population"))
    return prep.log_population(p)
