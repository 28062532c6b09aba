"""Agreement between coders, agreement at the levels of a code hierarchy, and wordings that carry several codes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.operators.retrieval import kept

#: Levels that a hierarchy may have; a walk that is longer than this has met a cycle.
DEEPEST = 64


# ---- double coding


def one_rating(ratings: DataFrame) -> DataFrame:
    """(item, rater, code): one rating of each coder and item, the smallest code of several; rows with a null are missing ratings."""
    rows = ratings.filter(F.col("item").isNotNull() & F.col("rater").isNotNull() & F.col("code").isNotNull())
    return rows.groupBy("item", "rater").agg(F.min("code").alias("code"))


def contingency(ratings: DataFrame, first, second) -> DataFrame:
    """(a, b, n): how often the two coders gave these codes to the same item; only pairs that occur."""
    rows = one_rating(ratings.filter(F.col("rater").isin(first, second)))
    of = lambda who: F.max(F.when(F.col("rater") == who, F.col("code")))
    both = rows.groupBy("item").agg(of(first).alias("a"), of(second).alias("b")).filter("a is not null and b is not null")
    return both.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def kappa(ratings: DataFrame, first, second) -> DataFrame:
    """One row: items that both coders rated, observed and chance agreement, and Cohen's kappa (1 where chance alone would agree always; null without items).

    Chance agreement needs the two margins of the contingency table, joined by code: no table of codes by codes is made.
    """
    table = kept(contingency(ratings, first, second))
    rows = table.groupBy(F.col("a").alias("code")).agg(F.sum("n").alias("na"))
    columns = table.groupBy(F.col("b").alias("code")).agg(F.sum("n").alias("nb"))
    chance = rows.join(columns, "code").agg(F.coalesce(F.sum(F.col("na").cast("double") * F.col("nb")), F.lit(0.0)).alias("products"))
    whole = table.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    n = F.nullif(F.col("n").cast("double"), F.lit(0.0))
    out = whole.crossJoin(chance).select("n", (F.col("same") / n).alias("observed"), (F.col("products") / (n * n)).alias("expected"))
    return out.withColumn("kappa", F.when(F.col("n") > 0, F.when(F.col("expected") >= 1, 1.0).otherwise((F.col("observed") - F.col("expected")) / (1 - F.col("expected")))))


def alpha(ratings: DataFrame) -> DataFrame:
    """One row: items with two ratings or more, their ratings, observed and expected disagreement, and Krippendorff's alpha for nominal codes.

    Missing ratings are no rows; an item with one rating has nothing to compare. Only counts of codes within an item
    and in all are needed. Alpha is 1 where all ratings are equal, and null without comparable ratings.
    """
    per = one_rating(ratings).groupBy("item", "code").agg(F.count(F.lit(1)).alias("c"))
    size = per.groupBy("item").agg(F.sum("c").alias("m")).filter("m >= 2")
    own = kept(per.join(size, "item"))
    # Of the m ratings of an item, c (c - 1) ordered pairs agree in a code, each of weight 1 / (m - 1)
    agree = own.agg(F.sum(F.col("c") * (F.col("c") - 1) / (F.col("m") - 1)).alias("agree"), F.coalesce(F.sum("c"), F.lit(0)).alias("n"))
    items = size.agg(F.count(F.lit(1)).alias("n_items"))
    margins = own.groupBy("code").agg(F.sum("c").alias("t")).agg(F.sum(F.col("t").cast("double") * (F.col("t") - 1)).alias("pairs"))
    n = F.nullif(F.col("n").cast("double"), F.lit(0.0))
    out = agree.crossJoin(items).crossJoin(margins).select("n_items", F.col("n").alias("n_ratings"), (1 - F.col("agree") / n).alias("observed"), (1 - F.col("pairs") / (n * (n - 1))).alias("expected"))
    return out.withColumn("alpha", F.when(F.col("expected") == 0, 1.0).otherwise(1 - F.col("observed") / F.col("expected")))


def adjudication(ratings: DataFrame) -> DataFrame:
    """(item, n_ratings, n_codes, majority, share, codes): the items whose coders disagree, for a third one to decide.

    codes: (code, n) from the most frequent on, ties by code; majority is null where no code has more than half.
    """
    per = one_rating(ratings).groupBy("item", "code").agg(F.count(F.lit(1)).alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("minus"), "code")))  # as many as an item has codes
    rows = per.groupBy("item").agg(F.sum("n").alias("n_ratings"), F.count(F.lit(1)).alias("n_codes"), ordered.alias("o")).filter("n_codes > 1")
    top = F.get("o", F.lit(0))
    share = -top["minus"] / F.col("n_ratings")
    codes = F.transform("o", lambda x: F.struct(x["code"].alias("code"), (-x["minus"]).alias("n")))
    return rows.select("item", "n_ratings", "n_codes", F.when(share > 0.5, top["code"]).alias("majority"), share.alias("share"), codes.alias("codes"))


def coding_plan(items: DataFrame, raters: list[str], n: int | None = None, each: int = 2, seed: int = 42) -> DataFrame:
    """(item, rater): `each` different coders for every item, or for `n` items drawn by a seeded hash; coders get about equally many, in all pairings of neighbours.

    The same items and seed give the same plan, and items that are added change nothing for the others but who is drawn.
    """
    if not 1 <= each <= len(set(raters)) or len(set(raters)) != len(raters):
        raise ValueError("Coders must differ, and there must be enough of them")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("item").cast("string")), 256)
    rows = items.select("item").filter(F.col("item").isNotNull()).distinct().withColumn("_h", digest)
    rows = rows if n is None else rows.orderBy("_h", "item").limit(n)
    first = F.conv(F.substring("_h", 1, 8), 16, 10).cast("long")
    names = F.array(*map(F.lit, raters))
    own = F.explode(F.transform(F.sequence(F.lit(0), F.lit(each - 1)), lambda i: F.get(names, ((first + i) % len(raters)).cast("int"))))
    return rows.select("item", own.alias("rater"))


# ---- hierarchies


def path_edges(terms: DataFrame, mark: str = ">") -> DataFrame:
    """(code, parent) out of terms (code, hierarchy), whose hierarchy is a path of codes from the root on, the code itself last or left out."""
    parts = F.filter(F.transform(F.split(F.coalesce("hierarchy", F.lit("")), mark), lambda p: F.trim(p)), lambda p: p != "")
    whole = F.when(F.element_at(parts, -1) == F.col("code"), parts).otherwise(F.concat(parts, F.array("code")))
    path = terms.select(F.when(F.size(parts) == 0, F.array("code")).otherwise(whole).alias("p"))
    pairs = F.transform(F.sequence(F.lit(1), F.size("p") - 1), lambda i: F.struct(F.element_at("p", i + 1).alias("code"), F.element_at("p", i).alias("parent")))
    return path.filter(F.size("p") > 1).select(F.inline(pairs)).distinct()


def ancestors(edges: DataFrame, deepest: int = DEEPEST) -> DataFrame:
    """(code, ancestor, up): every code with itself (up 0) and all that stand above it, by the shortest way.

    edges: (code, parent). Ways are doubled in each round, so a hierarchy of depth d takes log2(d) joins. ValueError if
    a code stands above itself or a way is longer than `deepest`.
    """
    e = edges.select("code", "parent").filter("code is not null and parent is not null").distinct()
    nodes = e.select("code").union(e.select("parent")).distinct()
    ways, reach = kept(e.select("code", F.col("parent").alias("ancestor"), F.lit(1).alias("up"))), 1
    while True:
        if not ways.filter("code = ancestor").isEmpty():
            raise ValueError("The hierarchy has a cycle")
        on = ways.alias("a").join(ways.alias("b"), F.col("a.ancestor") == F.col("b.code")).select(F.col("a.code").alias("code"), F.col("b.ancestor").alias("ancestor"), (F.col("a.up") + F.col("b.up")).alias("up"))
        more = kept(ways.unionByName(on).groupBy("code", "ancestor").agg(F.min("up").alias("up")))
        grown = more.count() > ways.count()
        ways, reach = more, reach * 2
        if not grown:
            break
        if reach > 2 * deepest:
            raise ValueError(f"The hierarchy is deeper than {deepest}")
    return nodes.select("code", F.col("code").alias("ancestor"), F.lit(0).alias("up")).unionByName(ways)


def common_ancestors(pairs: DataFrame, edges: DataFrame, up: DataFrame | None = None) -> DataFrame:
    """Distinct (gold_code, predicted_code) with their lowest common ancestor, its depth, and both codes' depths; nulls where they have none.

    The depth of a code is its longest way up, 0 for a root; of several common ancestors the deepest counts, ties by
    name. A code outside the hierarchy is a root of its own. up: ancestors(edges), where they are known.
    """
    up = kept(ancestors(edges)) if up is None else up
    asked = pairs.select("gold_code", "predicted_code").filter("gold_code is not null and predicted_code is not null").distinct()
    alone = asked.select(F.explode(F.array("gold_code", "predicted_code")).alias("code")).distinct().join(up.select("code"), "code", "left_anti")
    up = up.unionByName(alone.select("code", F.col("code").alias("ancestor"), F.lit(0).alias("up")))
    depth = up.groupBy("code").agg(F.max("up").alias("depth"))
    gold = asked.join(up.select(F.col("code").alias("gold_code"), "ancestor"), "gold_code")
    shared = gold.join(up.select(F.col("code").alias("predicted_code"), "ancestor"), ["predicted_code", "ancestor"])
    shared = shared.join(depth.select(F.col("code").alias("ancestor"), F.col("depth").alias("d")), "ancestor")
    lowest = shared.groupBy("gold_code", "predicted_code").agg(F.min(F.struct((-F.col("d")).alias("minus"), "ancestor")).alias("l"))
    named = lambda c, name: depth.select(F.col("code").alias(c), F.col("depth").alias(name))
    out = asked.join(lowest, ["gold_code", "predicted_code"], "left").join(named("gold_code", "gold_depth"), "gold_code").join(named("predicted_code", "predicted_depth"), "predicted_code")
    return out.select("gold_code", "predicted_code", F.col("l.ancestor").alias("common"), (-F.col("l.minus")).alias("common_depth"), "gold_depth", "predicted_depth")


def agreement_by_level(pred: DataFrame, edges: DataFrame) -> DataFrame:
    """(level, n, n_agree, rate): of the records whose gold code is at least `level` deep, how many predictions share its ancestor of that level; level -1 is the exact code.

    Predictions (gold_code, predicted_code) are counted by pair of codes first; a missing prediction agrees nowhere.
    """
    counts = pred.filter("gold_code is not null").groupBy("gold_code", "predicted_code").agg(F.count(F.lit(1)).alias("n"))
    up = kept(ancestors(edges))
    found = common_ancestors(counts, edges, up)
    own = counts.join(found, ["gold_code", "predicted_code"], "left")
    lost = counts.filter("predicted_code is null").select("gold_code").distinct()
    depth = up.groupBy("code").agg(F.max("up").alias("d"))
    own = own.join(lost.join(depth, F.col("gold_code") == F.col("code"), "left").select("gold_code", F.coalesce("d", F.lit(0)).alias("_d")), "gold_code", "left")
    levels = F.concat(F.array(F.lit(-1)), F.sequence(F.lit(0), F.coalesce("gold_depth", "_d", F.lit(0))))
    rows = own.select("n", "common_depth", (F.col("gold_code") == F.col("predicted_code")).alias("exact"), F.explode(levels).alias("level"))
    agree = F.when(F.col("level") == -1, F.coalesce("exact", F.lit(False))).otherwise(F.coalesce(F.col("common_depth") >= F.col("level"), F.lit(False)))
    return rows.groupBy("level").agg(F.sum("n").alias("n"), F.sum(F.when(agree, F.col("n")).otherwise(0)).alias("n_agree")).withColumn("rate", F.col("n_agree") / F.col("n"))


def hierarchy_similarity(pred: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: n, and the mean of 2 d(common) / (d(gold) + d(predicted)), depths counted from 1; 0 without a common ancestor or a prediction."""
    counts = pred.filter("gold_code is not null").groupBy("gold_code", "predicted_code").agg(F.count(F.lit(1)).alias("n"))
    near = 2.0 * (F.col("common_depth") + 1) / (F.col("gold_depth") + F.col("predicted_depth") + 2)
    rows = counts.join(common_ancestors(counts, edges), ["gold_code", "predicted_code"], "left")
    return rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), (F.sum(F.col("n") * F.coalesce(near, F.lit(0.0))) / F.sum("n")).alias("similarity"))


# ---- wordings with several codes


def surface_codes(labelled: DataFrame) -> DataFrame:
    """(surface, code, n) of rows (surface, code): lower-cased, trimmed wordings; blanks and nulls are left out."""
    rows = labelled.select(F.lower(F.trim("surface")).alias("surface"), "code").filter("surface <> '' and code is not null")
    return rows.groupBy("surface", "code").agg(F.count(F.lit(1)).alias("n"))


def conflicts(labelled: DataFrame) -> DataFrame:
    """(surface, n, n_codes, majority, share): the wordings that carry several codes, and how much their most frequent one has (ties by code)."""
    per = surface_codes(labelled)
    best = F.min(F.struct((-F.col("n")).alias("minus"), "code"))
    rows = per.groupBy("surface").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_codes"), best.alias("b")).filter("n_codes > 1")
    return rows.select("surface", "n", "n_codes", F.col("b.code").alias("majority"), (-F.col("b.minus") / F.col("n")).alias("share"))


def wordings(labelled: DataFrame) -> DataFrame:
    """(code, n, n_surfaces, most_frequent, share): in how many wordings a code comes, and the share of its most frequent one (ties by wording)."""
    per = surface_codes(labelled)
    best = F.min(F.struct((-F.col("n")).alias("minus"), "surface"))
    rows = per.groupBy("code").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_surfaces"), best.alias("b"))
    return rows.select("code", "n", "n_surfaces", F.col("b.surface").alias("most_frequent"), (-F.col("b.minus") / F.col("n")).alias("share"))


def code_groups(labelled: DataFrame) -> DataFrame:
    """(code, group): codes that wordings connect, directly or over other codes; a group is named by its smallest code.

    Labels spread between codes and wordings of the graph that surface_codes gives. In each round a code takes the
    smallest label that its wordings have seen, and then the label of that label, so that chains halve. Minima are made
    in each task before anything is shuffled; no pair of codes is ever made.
    """
    edges = kept(surface_codes(labelled).select("surface", "code"))
    label = kept(edges.select("code").distinct().withColumn("group", F.col("code")))
    while True:
        seen = edges.join(label, "code").groupBy("surface").agg(F.min("group").alias("least"))
        near = edges.join(seen, "surface").groupBy("code").agg(F.min("least").alias("group"))
        jump = near.join(label.select(F.col("code").alias("group"), F.col("group").alias("further")), "group", "left")
        new = kept(jump.select("code", F.least("group", F.coalesce("further", "group")).alias("group")))
        if new.alias("a").join(label.alias("b"), "code").filter("a.group <> b.group").isEmpty():
            return new
        label = new


def conflict_groups(labelled: DataFrame) -> DataFrame:
    """(group, n_codes, n_surfaces, n_conflicts): the connected groups of several codes, with their wordings and those that carry several codes."""
    groups = kept(code_groups(labelled))
    per = surface_codes(labelled).groupBy("surface").agg(F.count(F.lit(1)).alias("n_codes"), F.min("code").alias("code"))
    texts = per.join(groups, "code").groupBy("group").agg(F.count(F.lit(1)).alias("n_surfaces"), F.count_if(F.col("n_codes") > 1).alias("n_conflicts"))
    return groups.groupBy("group").agg(F.count(F.lit(1)).alias("n_codes")).filter("n_codes > 1").join(texts, "group")
