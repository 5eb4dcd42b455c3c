"""Graph operators over vertices (id, type, canonical) and edges (src, rel, dst)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from .checkpoints import cut
from .dedup import components
from .numbering import numbered


def both_ways(e: DataFrame) -> DataFrame:
    """(id, rel, other, direction): the edges are read once, each as a row from either end."""
    way = lambda a, b, name: F.struct(F.col(a).alias("id"), F.col(b).alias("other"), F.lit(name).alias("direction"))
    return e.select("rel", F.explode(F.array(way("src", "dst", "out"), way("dst", "src", "in"))).alias("x")).select("x.id", "rel", "x.other", "x.direction")


def neighbors(v: DataFrame, e: DataFrame, ids: DataFrame) -> DataFrame:
    """One hop in both directions from ids (id)."""
    ends = both_ways(e)
    names = v.select(F.col("id").alias("other"), F.col("type").alias("other_type"), F.col("canonical").alias("other_name"))
    return ends.join(ids.select("id").distinct().hint("merge"), "id", "left_semi").join(names.hint("merge"), "other")


def degrees(e: DataFrame) -> DataFrame:
    """Incident edges; a loop counts once."""
    ends = F.when(F.col("src") == F.col("dst"), F.array("src")).otherwise(F.array("src", "dst"))
    return e.select(F.explode(ends).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def subgraph(e: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """Edges within `depth` steps of start (id); the frontier of each step is cut from its lineage."""
    found, frontier = None, start.select("id").distinct()
    for _ in range(depth):
        a = e.join(frontier.select(F.col("id").alias("src")).hint("merge"), "src", "left_semi").select("src", "rel", "dst")
        b = e.join(frontier.select(F.col("id").alias("dst")).hint("merge"), "dst", "left_semi").select("src", "rel", "dst")
        found = cut((a.unionByName(b) if found is None else found.unionByName(a).unionByName(b)).distinct())
        frontier = found.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return found


def company_360(v: DataFrame, e: DataFrame) -> DataFrame:
    """(id, rel, direction, n, others) of companies: edges and distinct neighbours of each kind and direction.

    Ends are dealt by all that is grouped, over a number of tasks that is not made smaller, so that neither a well connected
    id nor small rows make a large task; what is left, a row for each id, kind and direction, meets the companies."""
    ends = both_ways(e).repartition(max(200, int(e.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "id", "rel", "direction", "other")
    each = ends.groupBy("id", "rel", "direction", "other").agg(F.count("*").alias("n"))
    sums = each.groupBy("id", "rel", "direction").agg(F.sum("n").alias("n"), F.count("other").alias("others"))
    return sums.join(v.where("type = 'company'").select("id").distinct().hint("merge"), "id", "left_semi").select("id", "rel", "direction", "n", "others")


def entity_activity(e: DataFrame, dated: DataFrame) -> DataFrame:
    """Edges at either end of an entity with their date, a loop once: the dates are joined to the edges, then each edge is a
    row of either end."""
    ends = F.when(F.col("src") == F.col("dst"), F.array("src")).otherwise(F.array("src", "dst"))
    rows = e.select("src", "rel", "dst").join(dated.hint("merge"), ["src", "dst"], "left")
    return rows.select(F.explode(ends).alias("id"), *rows.columns)


def investor_stats(portfolio: DataFrame) -> DataFrame:
    return portfolio.groupBy(F.col("src").alias("investor")).agg(F.countDistinct("dst").alias("portfolio"))


def coinvestors(portfolio: DataFrame, most: int = 1_000_000) -> DataFrame:
    """Pairs of investors (a < b) with the companies they share. The result is one row per pair that shares any.

    The pairs are counted first, and dealt over so many tasks that each makes about `most` of them."""
    p = cut(portfolio.select("src", "dst").distinct())
    pairs = p.groupBy("dst").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.lit(0.0))).first()[0]
    tasks = int(pairs / most) + 1
    own = p.repartition(tasks, "dst")
    met = own.select(F.col("src").alias("a"), "dst").join(own.select(F.col("src").alias("b"), "dst").hint("merge"), "dst").where("a < b")
    return met.repartition(tasks, "a", "b").groupBy("a", "b").agg(F.count("*").alias("shared")) if tasks > 1 else met.groupBy("a", "b").agg(F.count("*").alias("shared"))


def coinvestors_of(portfolio: DataFrame, investor: str) -> DataFrame:
    """(a, b, shared) of the pairs with this investor: from its companies out, so that no other pair is made."""
    p = portfolio.select("src", "dst").distinct()
    own = p.where(F.col("src") == investor).select("dst")
    met = p.where(F.col("src") != investor).join(own.hint("merge"), "dst", "left_semi").groupBy("src").agg(F.count("*").alias("shared"))
    return met.select(F.least("src", F.lit(investor)).alias("a"), F.greatest("src", F.lit(investor)).alias("b"), "shared")


def investor_leaderboard(portfolio: DataFrame, companies: DataFrame) -> DataFrame:
    """(investor, portfolio, sectors): the number of companies and their sectors. The companies themselves, whose lists
    grow with an investor, are `merge_lists` blocks or rows of the portfolio."""
    own = portfolio.select(F.col("src").alias("investor"), F.col("dst").alias("id")).join(companies.select("id", "sector"), "id")
    return own.groupBy("investor").agg(F.count("*").alias("portfolio"), F.array_join(F.array_sort(F.collect_set("sector")), ", ").alias("sectors"))


def ordered_companies(portfolio: DataFrame, companies: DataFrame, size: int = 10_000) -> DataFrame:
    """(investor, block, companies): every investor's companies by name, in lists of `size` numbered from 0."""
    own = portfolio.select(F.col("src").alias("investor"), F.col("dst").alias("id")).distinct().join(companies.select("id", "canonical").hint("merge"), "id")
    ranked = numbered(own, ["investor"], ["canonical", "id"]).withColumn("block", F.floor((F.col("n") - 1) / size))
    return ranked.groupBy("investor", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "canonical"))), lambda x: x["canonical"]).alias("companies"))


def intro_paths(ties: DataFrame, works: DataFrame, people: DataFrame, nodes: DataFrame, target: DataFrame, home: DataFrame, most: int | None = None) -> DataFrame:
    """(connector_id, connector, via, contact_id, contact, is_home): warm intros to the companies target (id).

    A contact works at the target; it and the connector are tied (ties: src, dst) to one of nodes (id, canonical), which is
    not the target itself; the connector does not work at the target. Connectors who work at one of home (id) are flagged
    and come first. With `most` the first so many rows by flag, name, id, node and contact: as every connector has a row,
    they are those of the first so many connectors, which are found before any path is made. Repeated ties are one path."""
    ids = lambda df, name: df.select(F.col("id").alias(name)).distinct().hint("merge")
    staff = works.join(ids(target, "dst"), "dst", "left_semi").select(F.col("src").alias("id")).distinct()
    own = works.join(ids(home, "dst"), "dst", "left_semi").select(F.col("src").alias("connector_id")).distinct().withColumn("is_home", F.lit(True))
    at = ties.join(ids(target, "dst"), "dst", "left_anti").join(ids(nodes, "dst"), "dst", "left_semi").select("src", "dst").distinct()
    bridges = cut(at.join(ids(staff, "src"), "src", "left_semi").select(F.col("src").alias("contact_id"), F.col("dst").alias("shared")))
    ends = at.join(ids(staff, "src"), "src", "left_anti").select(F.col("src").alias("connector_id"), F.col("dst").alias("shared"))
    names = lambda who: people.select(F.col("id").alias(f"{who}_id"), F.col("canonical").alias(who)).hint("merge")
    met = ends.join(bridges.select("shared").distinct().hint("merge"), "shared", "left_semi").select("connector_id").distinct()
    heads = met.join(names("connector"), "connector_id").join(own.hint("merge"), "connector_id", "left").withColumn("is_home", F.coalesce("is_home", F.lit(False)))
    if most is not None:
        heads = F.broadcast(cut(heads.orderBy(F.desc("is_home"), "connector", "connector_id").limit(most)))  # `most` rows
    else:
        heads = heads.hint("merge")
    out = ends.join(heads, "connector_id").join(bridges.hint("merge"), "shared").join(names("contact"), "contact_id")
    out = out.join(nodes.select(F.col("id").alias("shared"), F.col("canonical").alias("via")).hint("merge"), "shared").select("connector_id", "connector", "via", "contact_id", "contact", "is_home").distinct()
    return out if most is None else out.orderBy(F.desc("is_home"), "connector", "connector_id", "via", "contact_id").limit(most)


def company_investors(portfolio: DataFrame, investors: DataFrame, companies: DataFrame) -> DataFrame:
    """(company_id, investor_id, investor, portfolio): who invested in companies (id), and in how many companies they did."""
    p = portfolio.select("src", "dst").distinct()
    own = p.join(companies.select(F.col("id").alias("dst")).distinct().hint("merge"), "dst", "left_semi").select(F.col("dst").alias("company_id"), F.col("src").alias("investor_id"))
    sizes = p.groupBy(F.col("src").alias("investor_id")).agg(F.count("*").alias("portfolio"))
    return own.join(sizes.hint("merge"), "investor_id").join(investors.select(F.col("id").alias("investor_id"), F.col("canonical").alias("investor")).hint("merge"), "investor_id").select("company_id", "investor_id", "investor", "portfolio")


def referrer_paths(referred: DataFrame, people: DataFrame, works: DataFrame, home: DataFrame) -> DataFrame:
    """(company, referrer, person_id, is_home): who referred each company (company, referrer; blank: none), the least person
    of that name, if there is one, and whether they work at home (id)."""
    key = lambda c: F.lower(F.trim(c))
    one = people.groupBy(key("canonical").alias("key")).agg(F.min("id").alias("person_id"))
    own = works.join(home.select(F.col("id").alias("dst")).distinct().hint("merge"), "dst", "left_semi").select(F.col("src").alias("person_id")).distinct().withColumn("is_home", F.lit(True))
    rows = referred.where(F.trim("referrer") != "").select("company", F.trim("referrer").alias("referrer"), key("referrer").alias("key"))
    return rows.join(one.hint("merge"), "key", "left").join(own.hint("merge"), "person_id", "left").select("company", "referrer", "person_id", F.coalesce("is_home", F.lit(False)).alias("is_home"))


def colleagues(works: DataFrame, person: str) -> DataFrame:
    own = works.where(F.col("src") == person).select("dst", F.col("current").alias("c1"))
    return works.where(F.col("src") != person).join(own, "dst").groupBy(F.col("src").alias("person")).agg(F.count("*").alias("shared"), F.bool_or(F.col("current") & F.col("c1")).alias("both_current"))


def company_people(works: DataFrame, people: DataFrame, companies: DataFrame) -> DataFrame:
    """People of a set of company ids, current if any of their stints is."""
    own = works.join(companies.select(F.col("id").alias("dst")), "dst", "left_semi")
    return own.groupBy(F.col("src").alias("id")).agg(F.bool_or("current").alias("current"), F.min("start").alias("start")).join(people.select("id", "canonical"), "id")


def company_groups(companies: DataFrame, aliases: DataFrame) -> DataFrame:
    """(id, cluster) of all companies (id, canonical, website): those of one website, of one name, or of which one's alias
    (id, alias) is the other's name, in any case, and whatever follows from these; alone, its own id.

    Websites and names are one table of keys; each company of a key meets the least id that owns it, so the links are as
    many as keys, whatever their groups. An alias that is no company's name links nothing."""
    names = companies.select("id", F.lower(F.trim("canonical")).alias("key"))
    owners = names.unionByName(companies.select("id", F.concat(F.lit("\x01"), S.web_key("website")).alias("key"))).where("key <> ''")
    owners = cut(owners.distinct())
    heads = cut(owners.groupBy("key").agg(F.min("id").alias("head")))
    other = aliases.select("id", F.lower(F.trim("alias")).alias("key")).where("key <> ''").distinct()
    links = owners.unionByName(other).join(heads.hint("merge"), "key").where("id <> head").select(F.col("id").alias("a"), F.col("head").alias("b"))
    found = components(links)
    return companies.select("id").distinct().join(found.hint("merge"), "id", "left").select("id", F.coalesce("cluster", "id").alias("cluster"))


def group_people(works: DataFrame, people: DataFrame, groups: DataFrame) -> DataFrame:
    """(cluster, id, canonical, current, tenure): people of each company cluster, current if any stint is (an unknown one
    is), and the last of their tenures 'start – stop' as text, null if no date is known."""
    span = F.nullif(F.concat_ws(" – ", F.col("start").cast("string"), F.col("stop").cast("string")), F.lit(""))
    own = works.join(groups.select(F.col("id").alias("dst"), "cluster").hint("merge"), "dst")
    by = own.groupBy("cluster", F.col("src").alias("id")).agg(F.bool_or(F.coalesce("current", F.lit(True))).alias("current"), F.max(span).alias("tenure"))
    return by.join(people.select("id", "canonical").hint("merge"), "id").select("cluster", "id", "canonical", "current", "tenure")


def team_split(works: DataFrame) -> DataFrame:
    """Per company: people with a current stint, and those with past ones only."""
    by = works.groupBy("dst", "src").agg(F.bool_or("current").alias("current"))
    return by.groupBy(F.col("dst").alias("id")).agg(F.count_if("current").alias("now"), F.count_if(~F.col("current")).alias("past"))


def affiliations(works: DataFrame, schools: DataFrame, companies: DataFrame | None = None) -> DataFrame:
    """Per person: current employers, past ones that are not current, schools. An unknown `current` counts as true where the
    employer is one of companies (id), as false else."""
    if companies is not None:
        own = companies.select(F.col("id").alias("_c")).distinct()
        works = works.join(own.hint("merge"), F.col("dst") == F.col("_c"), "left").withColumn("current", F.coalesce("current", F.col("_c").isNotNull())).drop("_c")
    works = works.withColumn("current", F.coalesce("current", F.lit(False)))
    w = works.groupBy(F.col("src").alias("person")).agg(F.collect_set(F.when(F.col("current"), F.col("dst"))).alias("now"), F.collect_set(F.when(~F.col("current"), F.col("dst"))).alias("was"))
    s = schools.groupBy(F.col("src").alias("person")).agg(F.collect_set("dst").alias("schools"))
    return w.join(s, "person", "full").select("person", F.coalesce("now", F.array()).alias("now"), F.coalesce(F.array_except("was", "now"), F.array()).alias("past"), F.coalesce("schools", F.array()).alias("schools"))


def member_counts(ties: DataFrame) -> DataFrame:
    return ties.groupBy(F.col("dst").alias("id")).agg(F.countDistinct("src").alias("members"))


def hub_layer(companies: DataFrame, centre: str = "hub") -> DataFrame:
    sectors = companies.where("sector IS NOT NULL").select(F.lit(centre).alias("src"), F.lit("sector").alias("rel"), F.col("sector").alias("dst")).distinct()
    return sectors.unionByName(companies.where("sector IS NOT NULL").select(F.col("sector").alias("src"), F.lit("in_sector").alias("rel"), F.col("id").alias("dst")))


def orphan_nodes(v: DataFrame, e: DataFrame, types: list[str]) -> DataFrame:
    ends = e.select(F.col("src").alias("id")).unionByName(e.select(F.col("dst").alias("id"))).distinct()
    return v.where(F.col("type").isin(*types)).join(ends, "id", "left_anti")


def filter_graph(v: DataFrame, e: DataFrame, types: list[str], relations: list[str], sectors: list[str] | None = None) -> DataFrame:
    """Edges of these relations whose both ends are of these types; with sectors, companies of these only, and people and
    deals only if an edge ties them to such a company."""
    keep = v.where(F.col("type").isin(*types)).select("id", "type", *(["sector"] if sectors else []))
    if sectors:
        own = keep.where((F.col("type") == "company") & F.col("sector").isin(*sectors)).select("id")
        ends = e.select(F.col("src").alias("x"), F.col("dst").alias("id")).unionByName(e.select(F.col("dst").alias("x"), F.col("src").alias("id")))
        tied = ends.join(own.hint("merge"), "id", "left_semi").select(F.col("x").alias("id"))
        follow = keep.where(F.col("type").isin("person", "deal")).join(tied.hint("merge"), "id", "left_semi").select("id")
        keep = own.unionByName(follow).unionByName(keep.where(~F.col("type").isin("company", "person", "deal")).select("id"))
    keep = keep.select("id")
    out = e.where(F.col("rel").isin(*relations))
    return out.join(keep.select(F.col("id").alias("src")), "src", "left_semi").join(keep.select(F.col("id").alias("dst")), "dst", "left_semi")


def export_graph(v: DataFrame, e: DataFrame) -> DataFrame:
    """Nodes with their degree, ready for a JSON sink."""
    return v.join(degrees(e).hint("merge"), "id", "left").select("id", "type", "canonical", F.coalesce("degree", F.lit(0)).alias("degree"))
