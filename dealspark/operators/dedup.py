"""Identity clusters, survivors and merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .checkpoints import cut
from .knowledge import substrings


def core_of(canonical="canonical", kind="type") -> Column:
    """The name's core by the rule of its type: investors and organisations, schools, others."""
    return F.when(F.col(kind).isin("investor", "org"), S.investor_core(canonical)).when(F.col(kind) == "school", S.school_core(canonical)).otherwise(S.core_key(canonical))


def core_clusters(v: DataFrame, least: int = 3, core: Column | None = None) -> DataFrame:
    """(id, cluster, size): entities of one type with equal name cores; the cluster is its least id."""
    keyed = v.select("id", "type", (core_of() if core is None else core).alias("core")).where(F.length("core") >= least)
    groups = cut(keyed.groupBy("type", "core").agg(F.min("id").alias("cluster"), F.count("*").alias("size")).where("size > 1"))
    return keyed.join(groups.hint("merge"), ["type", "core"]).select("id", "cluster", "size")


def web_clusters(v: DataFrame) -> DataFrame:
    """(id, cluster): entities (id, website) of one website."""
    keyed = v.select("id", S.web_key("website").alias("web")).where("web IS NOT NULL")
    groups = cut(keyed.groupBy("web").agg(F.min("id").alias("cluster"), F.count("*").alias("size")).where("size > 1"))
    return keyed.join(groups.hint("merge"), "web").select("id", "cluster", "size")


def person_pairs(people: DataFrame) -> DataFrame:
    """Verdicts on pairs of people (id, name, slug, email, phone, company) that share a key.

    Candidates come from equi joins on slug, e-mail, phone and first name token with company, each led by the least id of
    its key, so a key with many people gives a pair per person. A conflict of keys is a veto.
    """
    first = F.concat_ws("|", F.split_part(F.lower(F.trim("name")), F.lit(" "), F.lit(1)), "company")
    keys = F.array(*[F.when(c.isNotNull(), F.concat(F.lit(k), c)) for k, c in (("s:", F.col("slug")), ("e:", F.col("email")), ("p:", F.col("phone")), ("n:", F.when(F.col("company").isNotNull(), first)))])
    rows = people.select("*", F.explode(F.filter(keys, lambda x: x.isNotNull())).alias("key"))
    heads = rows.groupBy("key").agg(F.min_by(F.struct("id", "name", "slug", "email", "phone", "company"), "id").alias("a"))
    p = rows.join(heads.hint("merge"), "key").where("id > a.id")
    differ = lambda c: F.col(c).isNotNull() & F.col(f"a.{c}").isNotNull() & (F.col(c) != F.col(f"a.{c}"))
    same = lambda c: F.coalesce(F.col(c) == F.col(f"a.{c}"), F.lit(False))
    la, lb = F.lower(F.trim("name")), F.lower(F.trim("a.name"))
    verdict = (
        F.when(differ("slug"), "veto: slug").when(differ("email"), "veto: email").when(differ("phone"), "veto: phone").when(same("slug"), "same slug").when(same("email"), "same email").when(same("phone"), "same phone")
        .when((la.startswith(lb) | lb.startswith(la)) & same("company") & (la != lb), "stub").when((la == lb) & same("company"), "same name").otherwise("distinct")
    )
    return p.select(F.col("a.id").alias("a"), F.col("id").alias("b"), verdict.alias("verdict")).distinct()


def dealt(df: DataFrame, *keys: str, rows: int = 20_000) -> DataFrame:
    """df over a number of tasks that grows with its rows (counted), for steps that make many rows of one."""
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.count() // rows), *keys)


def prefixes(toks: Column) -> Column:
    """All proper beginnings of a list of words, each as one text."""
    n = F.size(toks)
    return F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda k: F.array_join(F.slice(toks, 1, k), " "))).otherwise(F.array().cast("array<string>"))


def person_links(people: DataFrame) -> DataFrame:
    """(a, b, reason): verified links among people (id, name, slug, email, phone, companies, threads, degree), so many that
    all whom any verified pair connects are connected.

    A conflict of slug, e-mail or phone is a veto. Else two are one person by an equal slug or e-mail; by an equal phone
    with compatible names (one's words begin the other's); by equal names of two words or more with a shared company or
    thread; by equal single names with both; and a name without slug and e-mail that begins another's, with a shared
    company and thread, or with a shared company if it has no edge. Keys that are null conflict with nothing.

    No pairs are listed: within what two must share, those who lack or have the same keys in the same places agree with
    all of another such set alike, so each links to the least id of that set; the rows are a constant number for each
    person and shared thing, however many people share it."""
    some = lambda c: F.coalesce(F.array_distinct(F.filter(c, lambda x: x.isNotNull())), F.array().cast("array<string>"))
    toks = F.filter(F.split(F.regexp_replace(F.lower(F.coalesce("name", F.lit(""))), "[^a-z ]", " "), " +"), lambda x: x != "")
    p = dealt(people, "id").select("id", "slug", "email", "phone", toks.alias("toks"), some("companies").alias("cos"), some("threads").alias("thr"), F.coalesce("degree", F.lit(0)).alias("degree"))
    name, n = F.array_join("toks", " "), F.size("toks")
    none = F.array().cast("array<struct<kind:string,side:string,what:string>>")
    entry = lambda kind, side, *what: F.struct(F.lit(kind).alias("kind"), F.lit(side).alias("side"), F.concat_ws("\x1f", *what).alias("what"))
    each = lambda xs, f, when=F.lit(True): F.when(when, F.transform(xs, f)).otherwise(none)
    pairs = F.flatten(F.transform("cos", lambda c: F.transform("thr", lambda t: F.concat_ws("\x1e", c, t))))
    stub, over = F.col("slug").isNull() & F.col("email").isNull() & (n > 0), prefixes(F.col("toks"))
    longer = lambda kind, xs: F.flatten(F.transform(xs, lambda x: F.transform(over, lambda o: entry(kind, "long", o, x))))
    shared = F.concat(
        each(F.array(F.lit(1)), lambda _: entry("same slug", "", F.col("slug")), F.col("slug").isNotNull()), each(F.array(F.lit(1)), lambda _: entry("same email", "", F.col("email")), F.col("email").isNotNull()),
        each(F.array(F.lit(1)), lambda _: entry("same phone", "", F.col("phone"), name), F.col("phone").isNotNull() & (n > 0)), each(F.array(F.lit(1)), lambda _: entry("same phone, name begins", "short", name, F.col("phone")), F.col("phone").isNotNull() & (n > 0)),
        F.when(F.col("phone").isNotNull(), longer("same phone, name begins", F.array("phone"))).otherwise(none),
        each(F.col("cos"), lambda c: entry("same name, company", "", name, c), n > 1), each(F.col("thr"), lambda t: entry("same name, thread", "", name, t), n > 1), each(pairs, lambda x: entry("same name, company, thread", "", name, x), n == 1),
        each(pairs, lambda x: entry("name begins, company, thread", "short", name, x), stub), each(F.col("cos"), lambda c: entry("name begins, company", "short", name, c), stub & (F.col("degree") == 0)),
        longer("name begins, company, thread", pairs), longer("name begins, company", F.col("cos")),
    )
    keys = ("slug", "email", "phone")
    mask = sum((F.when(F.col(k).isNotNull(), 1 << i).otherwise(0) for i, k in enumerate(keys)), F.lit(0))
    rows = p.select("id", *keys, mask.alias("own"), F.explode(shared).alias("s")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(7))))
    common = F.concat_ws("\x1f", *[F.when(F.col("own").bitwiseAND(F.col("other")).bitwiseAND(F.lit(1 << i)) != 0, F.concat(F.lit(f"{i}"), F.col(k))) for i, k in enumerate(keys)])
    long = F.col("s.side") == "long"
    first, second = F.when(long, F.col("other")).otherwise(F.col("own")), F.when(long, F.col("own")).otherwise(F.col("other"))
    first, second = F.when(F.col("s.side") == "", F.least("own", "other")).otherwise(first), F.when(F.col("s.side") == "", F.greatest("own", "other")).otherwise(second)
    role = lambda side, m: F.concat(side, F.lit(":"), m.cast("string"))
    facing = F.when(F.col("s.side") == "short", "long").when(long, "short").otherwise("")
    rows = rows.select("id", F.col("s.kind").alias("reason"), F.concat_ws("\x1d", "s.kind", "s.what", first, second, common).alias("meet"), role(F.col("s.side"), F.col("own")).alias("role"), role(facing, F.col("other")).alias("facing"))
    rows = cut(rows)
    heads = cut(rows.groupBy("meet", "role").agg(F.min("id").alias("head")).withColumnsRenamed({"meet": "_meet", "role": "_role"}))
    met = rows.join(heads.hint("merge"), (F.col("meet") == F.col("_meet")) & (F.col("facing") == F.col("_role"))).where("id <> head")
    return met.groupBy(F.least("id", "head").alias("a"), F.greatest("id", "head").alias("b")).agg(F.min("reason").alias("reason"))


def person_classes(people: DataFrame) -> DataFrame:
    """(id, class): people alike in name, slug, e-mail, phone, companies, threads and in whether they have edges, by the
    least id. All that is judged of one is true of the others."""
    some = lambda c: F.array_sort(F.coalesce(F.array_distinct(F.filter(c, lambda x: x.isNotNull())), F.array().cast("array<string>")))
    words = F.filter(F.split(F.regexp_replace(F.lower(F.coalesce("name", F.lit(""))), "[^a-z ]", " "), " +"), lambda x: x != "")
    sign = F.struct(words.alias("toks"), "slug", "email", "phone", some("companies").alias("cos"), some("threads").alias("thr"), (F.coalesce("degree", F.lit(0)) == 0).alias("bare"))
    rows = cut(people.select("id", sign.alias("sign")))
    heads = cut(rows.groupBy("sign").agg(F.min("id").alias("class")))
    return rows.join(heads.hint("merge"), "sign").select("id", "class", "sign")


def bits(items: Column) -> Column:
    """A long in which each of the items sets one bit: lists whose longs have no bit in common have no item in common."""
    return F.aggregate(items, F.lit(0).cast("long"), lambda m, x: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(x), F.lit(64)).cast("int"))))


def kept_distinct(people: DataFrame, block: int = 4096) -> DataFrame:
    """(a, b, pairs, reason): classes of people (`person_classes`, by their least ids) whose names agree or of which one's
    begins the other's, and why they are not one person; pairs says of how many pairs of people that holds. A class of
    several that fails against itself is a row with a = b. Names without a word are never compared.

    Classes meet on a name and on the beginnings of longer names; people are never paired, only their classes. The classes of
    a name, and those of the names that it begins, are cut into blocks of about `block` by hash, and every two blocks meet in
    a cell of their own (two of one name once), so that a common name is a grid of cells of bounded size; tasks are as many
    as the pairs need. The work is the pairs', which are the result, so a pair must cost little: most are judged by a few
    numbers, and keys and lists are only read where these say that both have a key, or may share an item."""
    keys = ("slug", "email", "phone")
    c = person_classes(people.where("id IS NOT NULL")).groupBy("class", "sign").agg(F.count("*").alias("n")).select(F.col("class").alias("id"), "n", "sign.*").where(F.size("toks") > 0)
    known = sum((F.when(F.col(k).isNotNull(), 1 << i).otherwise(0) for i, k in enumerate(keys)), F.lit(0))
    rest = F.struct(*keys, "cos", "thr").alias("rest")
    c = cut(c.select("id", "n", F.size("toks").alias("words"), "toks", F.array_join("toks", " ").alias("key"), "bare", known.alias("known"), bits(F.col("cos")).alias("cos"), bits(F.col("thr")).alias("thr"), rest))
    over = c.withColumn("key", F.explode(prefixes(F.col("toks"))))
    # what makes a pair one person, by what it shares: nothing 1, a company 2, a thread 4, both 8
    same = F.when(F.col("words") > 1, 2 + 4 + 8).otherwise(8)
    begins = F.when(F.col("known").bitwiseAND(F.lit(3)) != 0, 0).when(F.col("bare"), 2 + 8).otherwise(8)
    count = lambda df, name: df.groupBy("key").agg(F.count("*").alias(name))
    size = count(c, "own").join(count(over, "over").hint("merge"), "key", "left").withColumn("over", F.coalesce("over", F.lit(0)))
    blocks = lambda n: F.ceil(F.col(n) / block).cast("int")
    size = cut(size.select("key", blocks("own").alias("_own"), blocks("over").alias("_over"), (F.col("own") * (F.col("own") / 2 + F.col("over"))).alias("work")))
    tasks = max(int(people.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(size.agg(F.coalesce(F.sum("work"), F.lit(0))).first()[0] * 2 // block**2))
    place = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    spread = lambda first, last, name: F.explode(F.sequence(first, last)).alias(name)
    facts = ("id", "n", "known", "cos", "thr", "rest")
    c, over = c.join(size.hint("merge"), "key"), over.join(size.hint("merge"), "key")
    own, other = c.withColumn("at", place("_own")), over.withColumn("at", place("_over"))
    mine = lambda df, kind, alike, no, j: df.select("key", F.lit(kind).alias("kind"), F.col("at").alias("i"), j, *[F.col(k).alias(f"x_{k}") for k in facts], alike.alias("alike"), F.lit(no).alias("no"))
    x = mine(own, "same", same, "same name but no shared company or thread", spread(F.col("at"), F.col("_own") - 1, "j")).withColumn("corner", F.col("i") == F.col("j"))
    x = x.unionByName(mine(own.where("_over > 0"), "begins", begins, "unverified (name only)", spread(F.lit(0), F.col("_over") - 1, "j")).withColumn("corner", F.lit(False)))
    theirs = lambda df, kind, i: df.select("key", F.lit(kind).alias("kind"), i, F.col("at").alias("j"), F.struct(*facts).alias("y"))
    y = theirs(own, "same", spread(F.lit(0), F.col("at"), "i")).unionByName(theirs(other, "begins", spread(F.lit(0), F.col("_own") - 1, "i")))
    cell = ["key", "kind", "i", "j"]
    y = y.repartition(tasks, *cell).groupBy(*cell).agg(F.array_sort(F.collect_list("y")).alias("ys"))
    met = x.repartition(tasks, *cell).join(y.hint("merge"), cell).select(*[f"x_{k}" for k in facts], "alike", "no", "corner", F.explode("ys").alias("y"))
    x, y = (lambda k: F.col(f"x_{k}")), (lambda k: F.col(f"y.{k}"))
    once = ~F.col("corner") | (x("id") < y("id")) | ((x("id") == y("id")) & (x("n") > 1))
    share = lambda k: F.when((x(k).bitwiseAND(y(k)) != 0) & F.arrays_overlap(x(f"rest.{k}"), y(f"rest.{k}")), 1).otherwise(0)
    shared = F.call_function("shiftleft", F.lit(1), share("cos") + 2 * share("thr"))
    keyless = x("known").bitwiseAND(y("known")) == 0
    differ = lambda k: F.coalesce(x(f"rest.{k}") != y(f"rest.{k}"), F.lit(False))
    met = met.where(once & F.when(keyless, F.col("alike").bitwiseAND(shared) == 0).otherwise(differ("slug") | differ("email") | differ("phone")))
    reason = F.when(keyless, F.col("no")).when(differ("slug"), "different slug").when(differ("email"), "different email").otherwise("different phone")
    pairs = F.when(F.col("corner") & (x("id") == y("id")), F.expr("x_n * (x_n - 1) div 2")).otherwise(x("n") * y("n"))
    lower = x("id") < y("id")
    return met.select(F.when(lower, x("id")).otherwise(y("id")).alias("a"), F.when(lower, y("id")).otherwise(x("id")).alias("b"), pairs.alias("pairs"), reason.alias("reason"))


def person_clusters(people: DataFrame) -> DataFrame:
    """(id, cluster): people connected by person_links; a cluster that comes to hold two slugs is left alone."""
    found = components(person_links(people).select("a", "b"))
    slugs = found.join(people.select("id", "slug").hint("merge"), "id").groupBy("cluster").agg(F.countDistinct("slug").alias("n")).where("n <= 1")
    return found.join(slugs.select("cluster").hint("merge"), "cluster", "left_semi").select("id", "cluster")


def company_links(companies: DataFrame, least: int = 4) -> DataFrame:
    """(a, b): companies (id, canonical, website, aliases) of one website; and of one core of at least `least` characters
    where one's name is an alias of the other or lies inside the other's name.

    Equal names are one node. Of cores with several names each name's substrings meet the names on an equi join."""
    web = companies.select("id", S.web_key("website").alias("web")).where("web IS NOT NULL")
    by_web = web.join(cut(web.groupBy("web").agg(F.min("id").alias("head"))).hint("merge"), "web").select("id", "head")
    own = companies.select("id", F.lower("canonical").alias("low"), S.core_key("canonical").alias("core"), "aliases").where(F.length("core") >= least)
    heads = cut(own.groupBy("core", "low").agg(F.min("id").alias("head")))
    equal = own.join(heads.hint("merge"), ["core", "low"]).select("id", "head")
    alias = own.select("id", "core", F.explode("aliases").alias("x")).select("id", "core", F.lower("x").alias("low")).join(heads.hint("merge"), ["core", "low"]).select("id", "head")
    several = heads.groupBy("core").agg(F.count("*").alias("n")).where("n > 1").select("core")
    parts = heads.join(several.hint("merge"), "core", "left_semi").select("core", F.col("head").alias("id"), F.explode(substrings(F.col("low"), least)).alias("low"))
    inside = parts.join(heads.hint("merge"), ["core", "low"]).select("id", "head")
    out = by_web.unionByName(equal).unionByName(alias).unionByName(inside).where("id <> head")
    return out.select(F.least("id", "head").alias("a"), F.greatest("id", "head").alias("b")).distinct()


def company_clusters(companies: DataFrame) -> DataFrame:
    """(id, cluster): companies connected by company_links."""
    return components(company_links(companies))


def components(pairs: DataFrame, rounds: int = 100) -> DataFrame:
    """(id, cluster): the least id reachable over pairs (a, b); labels spread with pointer jumping until nothing changes."""
    e = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    e = cut(e)
    label = cut(e.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("cluster")))
    for _ in range(rounds):
        near = e.join(label.select(F.col("id").alias("b"), "cluster"), "b").groupBy(F.col("a").alias("id")).agg(F.min("cluster").alias("m"))
        new = label.join(near, "id").select("id", F.least("cluster", "m").alias("cluster"), F.col("cluster").alias("old"))
        jump = label.select(F.col("id").alias("cluster"), F.col("cluster").alias("far"))
        new = cut(new.join(jump, "cluster", "left").select("id", F.least("cluster", F.coalesce("far", "cluster")).alias("cluster"), "old"))
        if new.where("cluster <> old").isEmpty():
            return new.select("id", "cluster")
        label = new.select("id", "cluster")
    raise RuntimeError("components did not settle")


#: What decides who of a cluster stays, in order; the least id after all. Of (degree, profile, canonical).
POLICIES = {
    "company": lambda: (F.coalesce("degree", F.lit(0)), F.col("profile")),
    "person": lambda: (F.col("profile"), F.size(F.filter(F.split(F.coalesce("canonical", F.lit("")), " +"), lambda x: x != "")), F.coalesce("degree", F.lit(0))),
    "core": lambda: (-F.length(F.coalesce("canonical", F.lit(""))), F.coalesce("degree", F.lit(0))),
    "degree": lambda: (F.coalesce("degree", F.lit(0)), -F.length(F.coalesce("canonical", F.lit("")))),
}


def pick_survivor(clusters: DataFrame, degree: DataFrame, names: DataFrame, policy: str = "degree", profiles: DataFrame | None = None) -> DataFrame:
    """(id, keeper) of clusters (id, cluster) by a policy of POLICIES: companies keep the best connected, then one with a
    profile (profiles: id); people one with a profile, then the fullest name, then the best connected; equal cores the
    shortest name; `degree` the best connected, then the shortest name. The best row is an aggregate, so a hot cluster is a
    row a task, and it is written before its members meet it."""
    has = profiles.select("id").distinct().withColumn("profile", F.lit(1)) if profiles is not None else None
    full = clusters.join(degree.hint("merge"), "id", "left").join(names.select("id", "canonical").hint("merge"), "id")
    full = full.join(has.hint("merge"), "id", "left") if has is not None else full.withColumn("profile", F.lit(None).cast("int"))
    full = full.withColumn("profile", F.coalesce("profile", F.lit(0)))
    rank = F.struct(*[(-c).alias(f"r{i}") for i, c in enumerate(POLICIES[policy]())], "id")
    first = cut(full.groupBy("cluster").agg(F.min(rank)["id"].alias("keeper")))
    return clusters.join(first.hint("merge"), "cluster").select("id", "keeper")


def repoint(e: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges with both ends moved to their keepers; loops and repeats go."""
    m = mapping.select("id", "keeper")
    out = e.join(m.select(F.col("id").alias("src"), F.col("keeper").alias("k1")), "src", "left").join(m.select(F.col("id").alias("dst"), F.col("keeper").alias("k2")), "dst", "left")
    return out.select(F.coalesce("k1", "src").alias("src"), "rel", F.coalesce("k2", "dst").alias("dst"), "envelope_id").where("src <> dst").distinct()


def move(df: DataFrame, mapping: DataFrame, column: str) -> DataFrame:
    """Rows (observations, tasks) whose `column` names a merged entity go to its keeper."""
    m = mapping.select(F.col("id").alias("_id"), F.col("keeper").alias("_keeper"))
    return df.join(m.hint("merge"), F.col(column) == F.col("_id"), "left").withColumn(column, F.coalesce("_keeper", column)).drop("_id", "_keeper")


def merge_profiles(profiles: DataFrame, mapping: DataFrame, key: str = "id") -> DataFrame:
    """One profile for each keeper: its own, else that of the loser of the least id."""
    m = mapping.select(F.col("id").alias("_id"), F.col("keeper").alias("_keeper"))
    to = F.coalesce("_keeper", key)
    rows = profiles.join(m.hint("merge"), F.col(key) == F.col("_id"), "left").withColumn("_to", to)
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("_to").orderBy(F.col(key) != F.col("_to"), key)))
    return rows.where("_n = 1").withColumn(key, F.col("_to")).drop("_id", "_keeper", "_to", "_n")


def merge_entities(v: DataFrame, mapping: DataFrame) -> DataFrame:
    """(id, canonical, attrs, aliases) of entities (id, canonical, attrs MAP, aliases ARRAY) after their merge.

    An attribute is the keeper's, else that of the loser of the least id. Aliases are the keeper's, then each loser's and
    its name, once each, without the keeper's own name in any case. Both are aggregated before a row is made of them."""
    m = mapping.select(F.col("id").alias("_id"), F.col("keeper").alias("_keeper"))
    rows = cut(v.join(m.hint("merge"), F.col("id") == F.col("_id"), "left").select("id", F.coalesce("_keeper", "id").alias("to"), "canonical", "attrs", "aliases").withColumn("loser", F.col("id") != F.col("to")))
    best = rows.select("to", "loser", "id", F.explode("attrs").alias("k", "v")).groupBy("to", "k").agg(F.min_by("v", F.struct("loser", "id")).alias("v"))
    attrs = best.groupBy("to").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("attrs"))
    names = F.concat(F.coalesce("aliases", F.array().cast("array<string>")), F.when(F.col("loser"), F.array("canonical")).otherwise(F.array().cast("array<string>")))
    each = rows.select("to", "loser", "id", F.posexplode(names).alias("i", "alias")).where("alias <> ''")
    keepers = rows.where("NOT loser").select("to", "canonical")
    each = each.groupBy("to", "alias").agg(F.min(F.struct("loser", "id", "i")).alias("at")).join(keepers.hint("merge"), "to").where(F.lower("alias") != F.lower("canonical"))
    lists = each.groupBy("to").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "alias"))), lambda x: x["alias"]).alias("aliases"))
    out = keepers.join(attrs.hint("merge"), "to", "left").join(lists.hint("merge"), "to", "left")
    return out.select(F.col("to").alias("id"), "canonical", F.coalesce("attrs", F.create_map().cast("map<string,string>")).alias("attrs"), F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"))


def dedup_plan(mapping: DataFrame, reason: str) -> DataFrame:
    return mapping.where("id <> keeper").select("keeper", F.col("id").alias("loser"), F.lit(reason).alias("reason"))


def inherit_notes(items: DataFrame, by: str = "content_hash") -> DataFrame:
    """(id, original): of items with one hash all take what the least id has; an item without a hash keeps its own."""
    first = cut(items.where(F.col(by).isNotNull()).groupBy(by).agg(F.min("id").alias("original")))
    return items.join(first.hint("merge"), by, "left").select("id", F.coalesce("original", "id").alias("original"))
