"""Features of a story for event clustering, and how similar two stories are."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire import rules
from tidewire.functions.text import concrete_pairs, effective_actions, entities_in, event_anchors, keyed, models_in, plain_words, tokens
from tidewire.operators.graph import cut, forget, spread_join

FEATURES = ("models", "entities", "tokens", "themes", "actions", "effective", "anchors", "pairs")


def _given(*names: str) -> list[Column]:
    return [F.nullif(n, F.lit("")) for n in names]


def with_features(df: DataFrame) -> DataFrame:
    """Add models, entities, tokens, themes, actions, effective actions, anchors and (entity, model) pairs.

    Titles, excerpt, summaries, tags and key points are read; the texts that the templates wrote are among them. Tags and
    key points are arrays; columns that are missing count as empty."""
    have = set(df.columns)
    text = lambda names: [c for n in names if n in have for c in _given(n)]
    listed = lambda names: [F.array_join(n, " ") for n in names if n in have]
    title = F.trim(F.concat_ws(" ", *text(["title", "title_ko", "title_en"])))
    seed = F.concat_ws(" ", title, *listed(["tags"]), *text(["excerpt"]))
    full = F.lower(F.concat_ws(" ", title, *text(["excerpt", "summary_ko", "summary_en"]), *listed(["tags", "key_points"])))
    out = df.withColumn("_full", full)
    out = out.withColumns(
        {
            "f_models": models_in("_full"), "f_entities": entities_in("_full"), "f_tokens": tokens(plain_words(seed), rules.STOP_WORDS, 2),
            "f_themes": keyed(F.col("_full"), rules.THEMES), "f_actions": keyed(F.col("_full"), rules.ACTIONS),
        }
    ).drop("_full")
    out = out.withColumn("f_effective", effective_actions(F.col("f_actions"), F.col("f_themes")))
    out = out.withColumn("f_anchors", event_anchors(F.col("f_effective"), F.col("f_entities"), F.col("f_models")))
    return out.withColumn("f_pairs", concrete_pairs(F.col("f_anchors")))


#: What ``with_features`` reads.
TEXTS = ("title", "title_ko", "title_en", "excerpt", "summary_ko", "summary_en", "tags", "key_points")


def with_features_once(df: DataFrame) -> DataFrame:
    """The rows of ``with_features``, written, in any order: texts that stories share are read once."""
    read = [c for c in TEXTS if c in df.columns]
    told = cut(df.withColumn("_text", F.unhex(F.sha2(F.to_json(F.struct(*read)), 256))))
    texts = told.groupBy("_text").agg(F.count(F.lit(1)).alias("_n"), *(F.any_value(c).alias(c) for c in read))
    # Dealt again by number of rows, as few texts would be read by one task.
    texts = cut(texts)
    found = cut(with_features(texts.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))).drop(*read))
    out = cut(spread_join(told, found, ["_text"], "_n", told.count()).drop("_text"))
    forget(told, texts, found)
    return out


def _both(a: Column, b: Column) -> Column:
    return F.array_intersect(a, b)


def _shares(a: Column, b: Column, *wanted: str) -> Column:
    return F.arrays_overlap(_both(a, b), F.array(*map(F.lit, wanted)))


def _only_one(a: Column, b: Column, name: str) -> Column:
    return F.array_contains(a, name) != F.array_contains(b, name)


def _action_pairs(anchors: Column, action: str) -> Column:
    return concrete_pairs(F.filter(anchors, lambda x: x["action"] == action))


def launch_context(a: Column, b: Column) -> Column:
    """A release in one and a price in the other of the same (entity, model)."""
    r = lambda x: _action_pairs(x, "release")
    p = lambda x: _action_pairs(x, "pricing")
    return F.arrays_overlap(r(a), p(b)) | F.arrays_overlap(p(a), r(b))


def pair_similarity(a: str = "a_", b: str = "b_", window_hours: float = rules.WINDOW_HOURS) -> Column:
    """The similarity of two stories whose columns have these prefixes: 0 to 1.

    The same id or address is 1. Else stories too far apart, without words, or on different companies, models, prices,
    offices or people are 0 unless their context joins them. Else shared words count, shared names, models, themes and
    actions add, and actions that clash take away. Sums are in a fixed order, as thresholds lie on their edges.
    """
    x = lambda n: (F.col(f"{a}f_{n}"), F.col(f"{b}f_{n}"))
    ents, mods, toks, themes, acts, anchors, pairs = map(x, ("entities", "models", "tokens", "themes", "effective", "anchors", "pairs"))
    same = F.lit(False)
    for c in ("article_id", "canonical_url", "url"):
        u, v = F.col(f"{a}{c}"), F.col(f"{b}{c}")
        same = same | F.coalesce((u == v) & (u != ""), F.lit(False))
    apart = F.abs(F.unix_micros(f"{a}published_at") - F.unix_micros(f"{b}published_at")) / F.lit(1e6) / F.lit(3600.0)
    far = F.coalesce(apart > window_hours, F.lit(False))
    jaccard = F.size(_both(*toks)) / F.size(F.array_union(*toks))
    n_shared = F.size(_both(*ents))
    has = lambda p: (F.size(p[0]) > 0) & (F.size(p[1]) > 0)
    disjoint = lambda p: has(p) & ~F.arrays_overlap(*p)
    joint = _shares(*themes, "partnership", "legal_policy", "security_safety") | _shares(*acts, "partnership", "legal", "security")
    rivals = disjoint(ents) & ~(joint & (jaccard >= 0.15))
    other_models = disjoint(mods) & ~((n_shared >= 2) | _shares(*themes, "partnership", "security_safety", "legal_policy", "benchmarking") | _shares(*acts, "partnership", "security", "legal"))
    priced = _only_one(*acts, "pricing")
    releasing = F.when(F.array_contains(acts[0], "pricing"), F.array_contains(acts[1], "release")).otherwise(F.array_contains(acts[0], "release"))
    launch = priced & releasing & (n_shared > 0) & F.arrays_overlap(*mods) & (F.size(mods[0]) == F.size(mods[1])) & (F.size(_both(*mods)) == F.size(mods[0])) & launch_context(*anchors)
    either = lambda i, n: F.array_contains(themes[i], n) | F.array_contains(acts[i], n)
    joined = _shares(*themes, "partnership", "investment", "model_release")
    moved = F.lit(False)
    for n in ("office_expansion", "executive_movement"):
        moved = moved | ((either(0, n) != either(1, n)) & ~joined)
    released = _only_one(*acts, "release")
    # What clashes with a release, its weight, the shared themes that excuse it.
    clashes = (("legal", 0.45, ("legal_policy", "partnership")), ("office_expansion", 0.40, ("model_release", "partnership")), ("executive_movement", 0.40, ("model_release", "partnership")), ("security", 0.40, ("security_safety", "partnership")), ("partnership", 0.40, ("partnership", "security_safety")))
    penalty = F.lit(0.0)
    for n, weight, excuse in clashes:
        excused = _shares(*themes, *excuse) | ((n_shared >= 2) if n == "partnership" else F.lit(False))
        penalty = penalty + F.when(_only_one(*acts, n) & released & ~excused, F.lit(weight)).otherwise(F.lit(0.0))
    all_themes = F.array_union(*themes)
    launch_only = F.size(F.array_except(all_themes, F.array(F.lit("model_release"), F.lit("benchmarking")))) == 0
    context = F.arrays_overlap(*acts) | F.arrays_overlap(*themes) | F.arrays_overlap(*mods) | (launch_only & (F.size(all_themes) > 0)) | launch | (jaccard >= 0.20)
    score = jaccard + F.when(n_shared >= 2, 0.30).when(n_shared == 1, F.when(context, 0.25).otherwise(0.05)).otherwise(0.0)
    score = score + F.when(F.arrays_overlap(*mods), 0.25).otherwise(0.0)
    score = score + F.when(F.arrays_overlap(*pairs), 0.05).otherwise(0.0)
    score = score + F.when(F.arrays_overlap(*themes), 0.15).when(launch_only & has(themes), 0.10).otherwise(0.0)
    score = score + F.when(F.arrays_overlap(*acts), 0.15).otherwise(0.0)
    barred = far | ~has(toks) | rivals | other_models | (priced & ~launch) | moved
    return F.when(same, F.lit(1.0)).when(barred, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score - penalty)))


def near_in_time(rows: DataFrame, key: str, pos: str, seconds: str, hours: float = rules.WINDOW_HOURS) -> DataFrame:
    """(key, u, v), u before v, of rows that share a key within so many hours: rows meet in cells of that length, each in
    its own and on one side in the next too, so that only neighbours in time are compared."""
    width = int(hours * 3600)
    named = rows.select(F.col(key).alias("key"), F.col(pos).alias("p"), F.col(seconds).alias("s"), F.floor(F.col(seconds) / F.lit(width)).alias("cell")).filter("s is not null")
    a = named.select("key", "cell", F.col("p").alias("pa"), F.col("s").alias("sa"))
    b = named.select("key", F.explode(F.array(F.col("cell"), F.col("cell") + 1)).alias("cell"), F.col("cell").alias("own"), F.col("p").alias("pb"), F.col("s").alias("sb"))
    met = a.join(b, ["key", "cell"]).filter((F.abs(F.col("sa") - F.col("sb")) <= width) & ((F.col("own") < F.col("cell")) | (F.col("pa") < F.col("pb"))) & (F.col("pa") != F.col("pb")))
    return met.select("key", F.least("pa", "pb").alias("u"), F.greatest("pa", "pb").alias("v"))


def near_counts(rows: DataFrame, key: str, pos: str, seconds: str, hours: float = rules.WINDOW_HOURS) -> DataFrame:
    """(key, n): how many pairs of ``near_in_time`` a key has, without making them; keys that have none are left out.

    All rows of a cell are near one another. A row and one of the next cell are near if the later one lies no further into its
    cell, which a running sum over the places in a cell counts: so work grows with the rows, and a key and two cells have no
    more places than two windows have seconds."""
    width = int(hours * 3600)
    named = cut(rows.select(F.col(key).alias("key"), F.col(pos).alias("p"), F.col(seconds).alias("s")).filter("key is not null and p is not null and s is not null"))

    def counted(of: DataFrame, keys: list[str]) -> DataFrame:
        cell = F.floor(F.col("s") / F.lit(width))
        placed = cut(of.groupBy(*keys, cell.alias("cell"), (F.col("s") - cell * F.lit(width)).alias("place")).agg(F.sum("n").alias("n")))
        here = placed.groupBy(*keys, "cell").agg(F.sum("n").alias("m")).select("key", F.expr("m * (m - 1) div 2").alias("n"))
        earlier = placed.select(*keys, (F.col("cell") + 1).alias("cell"), "place", F.col("n").alias("a"), F.lit(0).cast("long").alias("b"))
        both = earlier.unionByName(placed.select(*keys, "cell", "place", F.lit(0).cast("long").alias("a"), F.col("n").alias("b")))
        met = F.sum("b").over(Window.partitionBy(*keys, "cell").orderBy("place").rangeBetween(Window.unboundedPreceding, Window.currentRow))
        beyond = both.withColumn("met", met).select("key", (F.col("a") * F.col("met")).alias("n"))
        return here.unionByName(beyond).groupBy("key").agg(F.sum("n").alias("n"))

    all_pairs = counted(named.withColumn("n", F.lit(1).cast("long")), ["key"])
    # Rows of one position are no pair.
    one = named.groupBy("key", "p").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").drop("m")
    own = counted(named.join(one, ["key", "p"], "left_semi").withColumn("n", F.lit(1).cast("long")), ["key", "p"])
    both = all_pairs.unionByName(own.withColumn("n", -F.col("n")))
    return both.groupBy("key").agg(F.sum("n").alias("n")).filter("n > 0")


IDENTITIES = ("article_id", "canonical_url", "url")


def _seconds_apart(a: Column, b: Column) -> Column:
    return F.abs(a - b) / F.lit(1e6) / F.lit(3600.0)


#: The cell of stories without a time, which are near in time to all.
NO_CELL = -(1 << 40)


@dataclass
class StoryClasses:
    """Stories by what they say: ``members`` (pos, g, at, cell, same) name each story's class, its time in microseconds, its
    cell of time and the identities it shares; ``classes`` (g, n and the features) say it. A class is named by its first
    story."""

    members: DataFrame
    classes: DataFrame


def story_classes(features: DataFrame, order: str = "pos", window_hours: float = rules.WINDOW_HOURS) -> StoryClasses:
    """Stories with the same features are one class. An identity (id or address) is kept only where two stories share it.
    ``order`` has no repeated values."""
    wanted = [c for c in features.columns if c.startswith("f_")]
    own = features.select(F.col(order).alias("pos"), F.posexplode(F.array(*IDENTITIES)).alias("kind", "k")).filter("k is not null and k != ''")
    repeated = cut(own.groupBy("kind", "k").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    shared = spread_join(own, repeated, ["kind", "k"], "n", features.count()).groupBy("pos").agg(F.array_sort(F.collect_set(F.concat_ws(":", "kind", "k"))).alias("same"))
    at = F.unix_micros("published_at")
    cell = F.coalesce(F.floor(at / F.lit(int(window_hours * 3600 * 1e6))), F.lit(NO_CELL))
    told = features.select(F.col(order).alias("pos"), at.alias("at"), cell.alias("cell"), *wanted).join(shared, "pos", "left").withColumn("same", F.coalesce("same", F.array().cast("array<string>")))
    told = cut(told.withColumn("print", F.unhex(F.sha2(F.to_json(F.struct(*wanted)), 256))))
    prints = cut(told.groupBy("print").agg(F.min("pos").alias("g"), F.count(F.lit(1)).alias("n")))
    members = cut(spread_join(told.select("pos", "at", "cell", "same", "print"), prints, ["print"], "n", told.count()).select("pos", "g", "at", "cell", "same"))
    classes = cut(prints.drop("print").join(told.select(F.col("pos").alias("g"), *wanted), "g"))
    forget(told, prints, repeated)
    return StoryClasses(members, classes)


#: Classes of one word and cell that one task pairs with all others of it.
SLICE = 512


def beside(df: DataFrame, cell: str = "cell") -> DataFrame:
    """Each row under its own cell of time and the two beside it."""
    return df.withColumn(cell, F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.col(cell) + d)))


def _meeting(found: StoryClasses, least: float) -> DataFrame:
    """(g, h), g up to h, of classes that may be similar: they share an entity, a model or one of their first words, and have
    stories in the same cell of time or the next.

    Pairs that share neither entity nor model must owe at least ``least - 0.30`` to words, as themes and actions add no more.
    So the words that two such stories share are too many to be all among the last ones of both: words in one order, long
    ones first, meet without as many of the last as can be missed. Keys that very many classes have are dealt out in slices."""
    tagged = lambda c, t: F.transform(c, lambda v: F.concat(F.lit(t), v))
    ranked = F.array_sort(F.transform("f_tokens", lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))))
    n = F.size("f_tokens")
    first = F.slice(ranked, F.lit(1), F.greatest(F.lit(0), n - F.ceil(n * F.lit(least - 0.30 - 1e-9)).cast("int") + 1))["w"]
    keys = F.concat(tagged(first, "t:"), tagged(F.col("f_entities"), "e:"), tagged(F.col("f_models"), "m:"))
    when = found.members.select("g", "cell").distinct()
    keyed = cut(found.classes.select("g", F.explode(keys).alias("k")).join(when, "g"))
    some, none = keyed.filter(F.col("cell") != NO_CELL), keyed.filter(F.col("cell") == NO_CELL)
    # Without a time a class meets all others under no cell; with one, those of its own and the next cells.
    right = beside(some).unionByName(keyed.withColumn("cell", F.lit(NO_CELL)).distinct()).withColumnRenamed("g", "h")
    left = some.unionByName(none)
    slices = cut(right.groupBy("k", "cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(SLICE)).cast("int").alias("s")).filter("s > 1"))
    many = F.broadcast(slices) if slices.count() <= SLICE else slices
    dealt = lambda df: df.join(many, ["k", "cell"], "left").withColumn("s", F.coalesce("s", F.lit(1)))
    one = dealt(left).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("s") - 1))).drop("s")
    two = dealt(right).withColumn("slice", F.pmod(F.xxhash64("h"), F.col("s")).cast("int")).drop("s")
    met = cut(one.join(two, ["k", "cell", "slice"]).select(F.least("g", "h").alias("g"), F.greatest("g", "h").alias("h")).distinct())
    forget(keyed, slices)
    return met


def class_pairs(found: StoryClasses, least: float) -> DataFrame:
    """(g, h, similarity), g up to h, of classes whose stories reach ``least``, which must exceed 0.30, where they are near in
    time. A class is paired with itself, too, unless it has no words.

    A pair that shares no word, entity or model stays at 0.30 or below."""
    if least <= 0.30:
        raise ValueError("below 0.30 pairs that share nothing would count")
    # What is alike by id or address, or too far apart, is a matter of stories.
    nobody = [F.lit(None).cast("string").alias(c) for c in IDENTITIES] + [F.lit(None).cast("timestamp").alias("published_at")]
    told = found.classes.drop("n").select("*", *nobody)
    side = lambda p, key: told.select(F.col("g").alias(key), *(F.col(c).alias(f"{p}{c}") for c in told.columns if c != "g"))
    met = _meeting(found, least)
    judged = cut(met.join(side("a_", "g"), "g").join(side("b_", "h"), "h").select("g", "h", pair_similarity().alias("similarity")).filter(F.col("similarity") >= least))
    forget(met)
    return judged


def class_cells(found: StoryClasses) -> DataFrame:
    """(g, cell, node, lo, hi, n): stories of one class and cell of time, named by the first, with their first and last
    time."""
    return cut(found.members.groupBy("g", "cell").agg(F.min("pos").alias("node"), F.min("at").alias("lo"), F.max("at").alias("hi"), F.count(F.lit(1)).alias("n")))


def near_cells(nodes: DataFrame, pairs: DataFrame, window_hours: float = rules.WINDOW_HOURS) -> DataFrame:
    """(g, h, u, v): of each pair of classes, the cells that hold two stories within the window: the same cell, one beside it
    whose nearest end is near, and any where one of the two has no time."""
    a, b = (nodes.select(F.col("g").alias(key), "cell", *(F.col(c).alias(f"{p}{c}") for c in ("node", "lo", "hi"))) for p, key in (("a_", "g"), ("b_", "h")))
    mine = pairs.select("g", "h").join(a, "g")
    timed, untimed = mine.filter(F.col("cell") != NO_CELL), mine.filter(F.col("cell") == NO_CELL).drop("cell")
    apart = (F.greatest("a_lo", "b_lo") - F.least("a_hi", "b_hi")) / F.lit(1e6) / F.lit(3600.0)
    near = beside(timed).join(b.filter(F.col("cell") != NO_CELL), ["h", "cell"]).filter(apart <= window_hours).drop("cell")
    any_time = untimed.join(b.drop("cell"), "h").unionByName(timed.drop("cell").join(b.filter(F.col("cell") == NO_CELL).drop("cell"), "h"))
    return near.unionByName(any_time).select("g", "h", F.col("a_node").alias("u"), F.col("b_node").alias("v"))


def identical(members: DataFrame) -> DataFrame:
    """(key, pos, first): stories that share an id or address, with the first story that has it."""
    keyed = members.select("pos", F.explode("same").alias("key"))
    firsts = keyed.groupBy("key").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n"))
    return spread_join(keyed, firsts, ["key"], "n", members.count())


def similar_articles(features: DataFrame, least: float, order: str = "pos", window_hours: float = rules.WINDOW_HOURS) -> DataFrame:
    """(u, v, similarity), u before v in ``order``, of all pairs of stories that reach ``least``: members of similar classes
    within the window, and stories of one id or address at any time. Rows grow with the square of a repeated story;
    ``class_pairs`` with the members of the classes, and ``identical``, say the same in fewer."""
    found = story_classes(features, order, window_hours)
    one, two = (found.members.select(F.col("g").alias(key), "cell", *(F.col(c).alias(f"{p}{c}") for c in ("pos", "at", "same"))) for p, key in (("a_", "g"), ("b_", "h")))
    pairs = class_pairs(found, least).join(one, "g")
    near = beside(pairs.filter(F.col("cell") != NO_CELL)).join(two.filter(F.col("cell") != NO_CELL), ["h", "cell"])
    any_time = pairs.filter(F.col("cell") == NO_CELL).drop("cell").join(two.drop("cell"), "h").unionByName(pairs.filter(F.col("cell") != NO_CELL).drop("cell").join(two.filter(F.col("cell") == NO_CELL).drop("cell"), "h"))
    far = F.coalesce(_seconds_apart(F.col("a_at"), F.col("b_at")) > window_hours, F.lit(False))
    met = near.drop("cell").unionByName(any_time).filter(((F.col("g") != F.col("h")) | (F.col("a_pos") < F.col("b_pos"))) & ~far & ~F.arrays_overlap("a_same", "b_same"))
    like = met.select(F.least("a_pos", "b_pos").alias("u"), F.greatest("a_pos", "b_pos").alias("v"), "similarity")
    keyed = found.members.select("pos", F.explode("same").alias("key"))
    one_story = keyed.withColumnRenamed("pos", "u").join(keyed.withColumnRenamed("pos", "v"), "key").filter("u < v").select("u", "v").distinct()
    return cut(like.unionByName(one_story.withColumn("similarity", F.lit(1.0))))
