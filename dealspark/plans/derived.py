"""Domain tables derived from the star schema, so that every operator has data at any scale."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Tables:
    """The given tables of a folder, and what is derived from them; nothing is read before it is used."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def company(self) -> DataFrame:
        return self.customer.select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.lit("company").alias("type"), F.col("c_name").alias("canonical"), F.col("c_mktsegment").alias("sector"))

    def investor(self) -> DataFrame:
        return self.supplier.select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.lit("investor").alias("type"), F.col("s_name").alias("canonical"), F.lit(None).cast("string").alias("sector"))

    def employer(self) -> DataFrame:
        kind = F.when(F.col("s_suppkey") % 2 == 0, "company").otherwise("org")
        return self.supplier.select(F.concat(F.lit("g"), "s_suppkey").alias("id"), kind.alias("type"), F.col("s_name").alias("canonical"), F.lit(None).cast("string").alias("sector"))

    def school(self) -> DataFrame:
        return self.nation.select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.lit("school").alias("type"), F.col("n_name").alias("canonical"), F.lit(None).cast("string").alias("sector"))

    def person(self) -> DataFrame:
        return self.customer.select(F.concat(F.lit("p"), "c_custkey").alias("id"), F.lit("person").alias("type"), F.col("c_name").alias("canonical"), F.lit(None).cast("string").alias("sector"))

    def deal(self) -> DataFrame:
        return self.orders.select(F.concat(F.lit("d"), "o_orderkey").alias("id"), F.lit("deal").alias("type"), F.concat(F.lit("deal "), "o_orderkey").alias("canonical"), F.lit(None).cast("string").alias("sector"))

    def entity(self) -> DataFrame:
        out = self.company()
        for part in (self.investor(), self.employer(), self.school(), self.person(), self.deal()):
            out = out.unionByName(part)
        return out

    def _orders_of(self, cond) -> DataFrame:
        return self.lineitem.where(cond).join(self.orders, F.col("l_orderkey") == F.col("o_orderkey"))

    def invests_in(self) -> DataFrame:
        """Investor to company, distinct."""
        return self._orders_of(F.col("l_returnflag") == "R").select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("c"), "o_custkey").alias("dst")).distinct()

    def works_at(self) -> DataFrame:
        """Person to employer, with whether the job is current, its start and, if it is past, its stop."""
        rows = self._orders_of(F.col("l_returnflag") == "R").groupBy(F.concat(F.lit("p"), "o_custkey").alias("src"), F.concat(F.lit("g"), "l_suppkey").alias("dst"))
        out = rows.agg(F.bool_or(F.col("l_linestatus") == "O").alias("current"), F.min("l_shipdate").cast("date").alias("start"), F.max("l_shipdate").cast("date").alias("stop"))
        return out.withColumn("stop", F.when(~F.col("current"), F.col("stop")))

    def studied_at(self) -> DataFrame:
        return self.customer.select(F.concat(F.lit("p"), "c_custkey").alias("src"), F.concat(F.lit("n"), "c_nationkey").alias("dst"))

    def involves(self) -> DataFrame:
        return self.orders.select(F.concat(F.lit("d"), "o_orderkey").alias("src"), F.concat(F.lit("c"), "o_custkey").alias("dst"))

    def edge(self) -> DataFrame:
        parts = [("invests_in", self.invests_in()), ("works_at", self.works_at()), ("studied_at", self.studied_at()), ("involves", self.involves())]
        frames = [df.select("src", F.lit(rel).alias("rel"), "dst", F.lit(None).cast("string").alias("envelope_id")) for rel, df in parts]
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out

    def observation(self) -> DataFrame:
        metric, conf = F.substring("o_orderpriority", 1, 1), F.col("o_orderstatus")
        return self.orders.select(
            F.col("o_orderkey").alias("id"), F.concat(F.lit("c"), "o_custkey").alias("entity_id"),
            F.when(metric == "1", "revenue").when(metric == "2", "ebitda").when(metric == "3", "valuation").when(metric == "4", "funding_ask").otherwise("net_profit").alias("metric"),
            F.when(F.col("o_orderkey") % 29 != 0, F.col("o_totalprice")).alias("value_num"), F.col("o_orderdate").cast("date").alias("as_of"),
            F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("FY"), F.date_format("o_orderdate", "yy"))).alias("period"),
            F.when(conf == "F", "Verified").when(conf == "O", "High").otherwise("Medium").alias("confidence"),
            F.when(F.col("o_orderkey") % 3 == 0, "Registry").otherwise("deck").alias("source"), F.col("o_orderdate").cast("date").alias("created_at"),
        )

    def task(self) -> DataFrame:
        return self.orders.where(F.substring("o_orderpriority", 1, 1).isin("1", "2")).select(
            F.col("o_orderkey").alias("id"), F.concat(F.lit("c"), "o_custkey").alias("company_id"), F.date_add(F.col("o_orderdate").cast("date"), 14).alias("due_date"),
            F.when(F.col("o_orderstatus") == "F", "done").otherwise("open").alias("status"), F.col("o_orderdate").cast("date").alias("created_at"),
        )

    def note(self) -> DataFrame:
        """Orders as notes about companies: an ask where the order is in progress, the priority as round."""
        o = self.orders.join(self.customer, F.col("o_custkey") == F.col("c_custkey"))
        return o.select(
            F.col("o_orderkey").alias("id"), F.col("c_name").alias("company_name"), F.col("c_mktsegment").alias("sector"),
            F.when(F.col("o_orderstatus") == "P", F.col("o_totalprice")).alias("ask"), F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderpriority")).alias("round_type"),
            F.col("o_orderdate").cast("date").alias("occurred_at"), F.date_add(F.col("o_orderdate").cast("date"), (F.col("o_orderkey") % 7).cast("int")).alias("ingested_at"),
        )

    def raw_item(self) -> DataFrame:
        chat = self.conversations.select(F.lit("chat").alias("source"), F.concat_ws("-", "conv_id", "turn").alias("source_id"), F.col("text").alias("body"))
        docs = self.documents.select("source", F.col("doc_id").cast("string").alias("source_id"), F.col("text").alias("body"))
        return chat.unionByName(docs)


#: The same definitions as SQL, for the oracle.
SQL = {
    "company": "SELECT 'c' || c_custkey AS id, 'company' AS type, c_name AS canonical, c_mktsegment AS sector FROM customer",
    "investor": "SELECT 's' || s_suppkey AS id, 'investor' AS type, s_name AS canonical, CAST(NULL AS VARCHAR) AS sector FROM supplier",
    "employer": "SELECT 'g' || s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'company' ELSE 'org' END AS type, s_name AS canonical, CAST(NULL AS VARCHAR) AS sector FROM supplier",
    "school": "SELECT 'n' || n_nationkey AS id, 'school' AS type, n_name AS canonical, CAST(NULL AS VARCHAR) AS sector FROM nation",
    "person": "SELECT 'p' || c_custkey AS id, 'person' AS type, c_name AS canonical, CAST(NULL AS VARCHAR) AS sector FROM customer",
    "deal": "SELECT 'd' || o_orderkey AS id, 'deal' AS type, 'deal ' || o_orderkey AS canonical, CAST(NULL AS VARCHAR) AS sector FROM orders",
    "entity": "SELECT * FROM company UNION ALL SELECT * FROM investor UNION ALL SELECT * FROM employer UNION ALL SELECT * FROM school UNION ALL SELECT * FROM person UNION ALL SELECT * FROM deal",
    "invests_in": "SELECT DISTINCT 's' || l_suppkey AS src, 'c' || o_custkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'",
    "works_at": "SELECT 'p' || o_custkey AS src, 'g' || l_suppkey AS dst, bool_or(l_linestatus = 'O') AS current, CAST(min(l_shipdate) AS DATE) AS start, CASE WHEN NOT bool_or(l_linestatus = 'O') THEN CAST(max(l_shipdate) AS DATE) END AS stop FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' GROUP BY 1, 2",
    "studied_at": "SELECT 'p' || c_custkey AS src, 'n' || c_nationkey AS dst FROM customer",
    "involves": "SELECT 'd' || o_orderkey AS src, 'c' || o_custkey AS dst FROM orders",
    "edge": "SELECT src, 'invests_in' AS rel, dst FROM invests_in UNION ALL SELECT src, 'works_at', dst FROM works_at UNION ALL SELECT src, 'studied_at', dst FROM studied_at UNION ALL SELECT src, 'involves', dst FROM involves",
    "observation": "SELECT o_orderkey AS id, 'c' || o_custkey AS entity_id, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'revenue' WHEN '2' THEN 'ebitda' WHEN '3' THEN 'valuation' WHEN '4' THEN 'funding_ask' ELSE 'net_profit' END AS metric, CASE WHEN o_orderkey % 29 <> 0 THEN o_totalprice END AS value_num, CASE WHEN o_orderkey % 5 = 0 THEN 'FY' || strftime(CAST(o_orderdate AS DATE), '%y') END AS period, CAST(o_orderdate AS DATE) AS as_of, CASE o_orderstatus WHEN 'F' THEN 'Verified' WHEN 'O' THEN 'High' ELSE 'Medium' END AS confidence, CASE WHEN o_orderkey % 3 = 0 THEN 'Registry' ELSE 'deck' END AS source, CAST(o_orderdate AS DATE) AS created_at FROM orders",
    "task": "SELECT o_orderkey AS id, 'c' || o_custkey AS company_id, CAST(o_orderdate AS DATE) + 14 AS due_date, CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE 'open' END AS status, CAST(o_orderdate AS DATE) AS created_at FROM orders WHERE substr(o_orderpriority, 1, 1) IN ('1', '2')",
    "note": "SELECT o_orderkey AS id, c_name AS company_name, c_mktsegment AS sector, CASE WHEN o_orderstatus = 'P' THEN o_totalprice END AS ask, CASE WHEN o_orderkey % 4 = 0 THEN o_orderpriority END AS round_type, CAST(o_orderdate AS DATE) AS occurred_at, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 7 AS INTEGER) AS ingested_at FROM orders JOIN customer ON o_custkey = c_custkey",
    "raw_item": "SELECT 'chat' AS source, conv_id || '-' || turn AS source_id, text AS body FROM conversations UNION ALL SELECT source, CAST(doc_id AS VARCHAR), text FROM documents",
}
NEEDS = {"entity": ["company", "investor", "employer", "school", "person", "deal"], "edge": ["invests_in", "works_at", "studied_at", "involves"]}


def sql(body: str, *names: str) -> str:
    """body after a WITH of the derived tables named, and of what they are made of."""
    if not names:
        return body
    wanted = list(dict.fromkeys(x for n in names for x in [*NEEDS.get(n, []), n]))
    ctes = ", ".join(f"{n} AS ({SQL[n]})" for n in wanted)
    for head in ("WITH RECURSIVE ", "WITH "):
        if body.startswith(head):
            return f"{head}{ctes}, {body[len(head):]}"
    return f"WITH {ctes} {body}"
