"""The curated knowledge base: visibility, similarity, merge and summaries.

A row is ``category, section, status, title, body, created_at, updated_at``;
status D is a draft, V verified, X deprecated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import config as C
from ..functions.columns import consumer, status_rank, word_set
from .similar import compared, may_be_similar, signed

KEY = ("category", "title_key")


def visible(kb: DataFrame) -> DataFrame:
    """Rows a reader may see: no X; adds ``unverified`` and ``safe_for_high_risk``."""
    return kb.filter(F.col("status") != "X").withColumns({"unverified": F.col("status") == "D", "safe_for_high_risk": F.col("status") == "V"})


def route(kb: DataFrame, *needs: str) -> DataFrame:
    """Rows of the one or two categories that ``needs`` lead to: a partition filter."""
    wanted = list(dict.fromkeys(C.ROUTES[n] for n in needs))
    if not 1 <= len(wanted) <= 2:
        raise ValueError("a read takes one or two categories")
    return kb.filter(F.col("category").isin(*wanted))


def in_scope(kb: DataFrame, scope: str = "all") -> DataFrame:
    """Rows a partial sync touches."""
    return kb.filter(F.col("category").isin(*C.SCOPES[scope]))


def with_consumer(kb: DataFrame) -> DataFrame:
    return kb.withColumn("consumer", consumer(F.col("category")))


def winners(rows: DataFrame, *key: str, tie: str) -> DataFrame:
    """One row of each group: verified before draft before others, then the newest, then the smallest ``tie``."""
    best = Window.partitionBy(*key).orderBy(status_rank(F.col("status")), F.col("updated_at").desc_nulls_last(), tie)
    return rows.withColumn("__r", F.row_number().over(best)).filter("__r = 1").drop("__r")


def title_key(title: Column) -> Column:
    """Topics are equal if their titles have the same words."""
    return F.array_join(word_set(title), " ")


def similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two word sets; two empty ones are alike."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, 1.0).otherwise(both / union)


def similar_pairs(rows: DataFrame, *block: str, id: str = "id", text: str = "text", least: float = C.SIMILAR) -> DataFrame:
    """Pairs ``id_a < id_b`` of *different* texts in the same block whose word sets' similarity is over ``least``.

    Equal texts are one (their smallest id), so copies make no pairs.  Pairs
    meet only on a rare word: sets as alike as ``least`` share one of the first
    ``n - ceil(least * n) + 1`` words in the order of rarity.  Texts are dealt
    out only where a bound of their overlap lets a pair pass, once for a neighbourhood.
    """
    pairs = may_be_similar(signed(rows, id, text, least, *block), least, *block)
    return compared(pairs, rows, id, text).filter(F.col("similarity") > least)


def exact_groups(rows: DataFrame, *block: str, id: str = "id", text: str = "text") -> DataFrame:
    """Groups of equal texts: ``text_key, n, first_id, last_id``."""
    return rows.groupBy(*block, F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_key")).agg(F.count("*").alias("n"), F.min(id).alias("first_id"), F.max(id).alias("last_id"))


def truly_new(existing: DataFrame, incoming: DataFrame, text: str = "text") -> DataFrame:
    """Incoming rows whose text no existing row has, word for word."""
    key = F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    return incoming.withColumn("__key", key).join(existing.select(key.alias("__key")).distinct(), "__key", "left_anti").drop("__key")


def classify(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Adds ``action`` and the matched row to each incoming row.

    ``new`` has no live topic of its title; else by the bodies' similarity:
    ``duplicate`` over 0.90, ``conflict`` if both name the same ``fact_key`` with
    different ``fact_value``, else ``supplement``.  A small semi join on titles
    comes first; bodies are read only where titles meet.
    """
    new = incoming.withColumn("title_key", title_key(F.col("title")))
    live = existing.filter(F.col("status") != "X").withColumn("title_key", title_key(F.col("title")))
    old = winners(live.join(new.select(*KEY).distinct(), list(KEY), "left_semi"), *KEY, tie="body")
    met = new.join(old.select(*KEY, F.col("status").alias("old_status"), F.col("body").alias("old_body"), F.col("fact_key").alias("old_key"), F.col("fact_value").alias("old_value")), list(KEY), "left")
    alike = similarity(word_set(F.col("body")), word_set(F.col("old_body")))
    clash = (F.col("fact_key") == F.col("old_key")) & (F.col("fact_value") != F.col("old_value"))
    action = F.when(F.col("old_status").isNull(), "new").when(F.coalesce(clash, F.lit(False)), "conflict").when(alike > C.SIMILAR, "duplicate").otherwise("supplement")
    return met.withColumn("action", action)


def merge(existing: DataFrame, incoming: DataFrame, now: Column, deprecate_verified: bool = False) -> DataFrame:
    """The knowledge base after a sync.  Rows also have ``fact_key`` and ``fact_value`` (null for none).

    * new: appended as D;  * duplicate: the old row's time is refreshed;
    * supplement: words that the old body lacks are kept by appending the new body to it;
    * conflict: the old row becomes X and the new one is appended as D.

    Verified rows are never edited; a supplement or conflict of one is appended
    as D beside it, unless ``deprecate_verified`` lets conflicts deprecate it.
    Merging the same rows again changes nothing but refreshed times.
    """
    columns = existing.columns
    incoming = incoming.dropDuplicates(["category", "title", "body"])
    # What a live draft says word for word is only confirmed.
    own = ["category", "title", "body"]
    drafts = existing.filter("status = 'D'").select(*own).distinct()
    again = incoming.join(drafts, own, "left_semi").select(*own).withColumn("__again", F.lit(True))
    incoming = incoming.join(drafts, own, "left_anti")
    mine = existing.withColumn("title_key", title_key(F.col("title")))
    marked = classify(existing, incoming)
    events = marked.groupBy(*KEY).agg(
        F.max((F.col("action") == "duplicate").cast("int")).alias("dup"),
        F.max((F.col("action") == "conflict").cast("int")).alias("clash"),
        F.array_sort(F.collect_set(F.when(F.col("action") == "supplement", F.col("body")))).alias("more"),
    )
    held = mine.join(again, own, "left").join(events, list(KEY), "left").withColumnsRenamed({"status": "__status", "body": "__body", "updated_at": "__updated"})
    lacking = F.filter(F.coalesce("more", F.expr("cast(array() as array<string>)")), lambda b: ~F.contains(F.coalesce("__body", F.lit("")), b))
    held = held.withColumns({"__fresh": lacking, "__hit": F.coalesce("clash", F.lit(0)) == 1, "__same": (F.coalesce("dup", F.lit(0)) == 1) | F.coalesce("__again", F.lit(False))})
    draft, hit, more = F.col("__status") == "D", F.col("__hit"), F.size("__fresh") > 0
    fallen = hit & (draft | ((F.col("__status") == "V") & F.lit(deprecate_verified)))
    kept = held.withColumns(
        {
            "status": F.when(fallen, "X").otherwise(F.col("__status")),
            "body": F.when(draft & ~hit & more, F.concat_ws("\n", "__body", F.array_join("__fresh", "\n"))).otherwise(F.col("__body")),
            "updated_at": F.when(fallen | (draft & (F.col("__same") | more)), now).otherwise(F.col("__updated")),
        }
    ).select(*columns)
    beside = marked.filter((F.col("action").isin("new", "conflict")) | ((F.col("action") == "supplement") & (F.col("old_status") == "V")))
    added = beside.withColumns({"status": F.lit("D"), "created_at": now, "updated_at": now})
    return kept.unionByName(added.select(*columns))


def promote(kb: DataFrame, evidence: DataFrame) -> DataFrame:
    """Drafts with evidence (``category, title, kind``: user, tool or reference) become verified."""
    proven = evidence.filter(F.col("kind").isin("user", "tool", "reference")).select("category", "title").distinct().withColumn("__ok", F.lit(True))
    return kb.join(proven, ["category", "title"], "left").withColumn("status", F.when((F.col("status") == "D") & F.col("__ok"), "V").otherwise(F.col("status"))).select(*kb.columns)


def finish(kb: DataFrame, done: DataFrame, section: str = "Done") -> DataFrame:
    """Items of ``done`` (``category, title``) move to the section of finished ones."""
    marks = done.select("category", "title").distinct().withColumn("__done", F.lit(True))
    return kb.join(marks, ["category", "title"], "left").withColumn("section", F.when(F.col("__done"), F.lit(section)).otherwise(F.col("section"))).select(*kb.columns)


def index(kb: DataFrame) -> DataFrame:
    """``category, entries, last_updated`` of live entries and the total (``category`` null)."""
    return kb.filter("status <> 'X'").rollup("category").agg(F.count("*").alias("entries"), F.max("updated_at").alias("last_updated"))


def render_index(kb: DataFrame, most: int = 200) -> DataFrame:
    """The index as Markdown lines ``n, line``, the total last; raises where it would have ``most`` lines or more, and drops none."""
    rows = index(kb).select(F.coalesce("category", F.lit("total")).alias("name"), F.col("category").isNull().cast("int").alias("last"), "entries", "last_updated")
    numbered = rows.select(F.row_number().over(Window.orderBy("last", "name")).alias("n"), F.format_string("| %s | %d | %s |", "name", "entries", F.coalesce(F.col("last_updated").cast("string"), F.lit("-"))).alias("line"))
    if (lines := rows.count()) >= most:
        raise ValueError(f"the index has {lines} lines; fewer than {most} are allowed")
    return numbered


def sync_summary(classified: DataFrame) -> DataFrame:
    """Incoming rows by category and action."""
    return classified.groupBy("category").pivot("action", ["new", "duplicate", "supplement", "conflict"]).count().na.fill(0)


def section_counts(kb: DataFrame) -> DataFrame:
    """Open and finished items of each category."""
    done = F.lower(F.coalesce("section", F.lit(""))).isin("done", "decided", "done items", "decided items")
    return kb.filter("status <> 'X'").groupBy("category").agg(F.count_if(~done).alias("open"), F.count_if(done).alias("done"))


def priority(section: Column) -> Column:
    """0 to 3 for sections that begin with high, medium, low or done, 4 for others."""
    rank = F.lit(4)
    for k, name in reversed(list(enumerate(("high", "medium", "low", "done")))):
        rank = F.when(F.lower(section).startswith(name), k).otherwise(rank)
    return rank


def by_priority(items: DataFrame) -> DataFrame:
    """Items in the order high, medium, low, done, others."""
    return items.orderBy(priority(F.col("section")), "title")
