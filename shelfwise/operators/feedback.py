"""Feedback, flags, hidden authors, recategorizing (Q34: D7-D10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import text as X
from ..schema import LibraryState, assign_ids

KEY = ("_t", "_a", "format")
#: What each action sets (None: unset in a new row).
ACTIONS: dict[str, dict[str, bool | None]] = {
    "thumbs_up": {"thumbs_up": True, "thumbs_down": False},
    "thumbs_down": {"thumbs_up": False, "thumbs_down": True},
    "non_english": {"non_english": True},
    "already_read": {"already_read": True},
    "duplicate": {"duplicate": True},
}
FLAGS = ("thumbs_up", "thumbs_down", "non_english", "already_read", "duplicate")


def _keyed(df: DataFrame) -> DataFrame:
    return df.withColumns({"_t": X.lower_trim(F.col("title")), "_a": X.lower_trim(F.col("author"))})


def apply_feedback(state: LibraryState, events: DataFrame, now: Column) -> tuple[DataFrame, LibraryState]:
    """D7, D8 for many events: (title, author, format, action, at). Of the events of a key, each flag takes the value of
    the latest that sets it. Blank titles or authors are refused. New rows leave flags that nothing set unset, but
    non_english, already_read and duplicate false. plan: id, action (update, insert)."""
    good = _keyed(events).filter("_t <> '' AND _a <> ''").filter(F.col("action").isin(*ACTIONS))
    sets = {f: [(a, v[f]) for a, v in ACTIONS.items() if f in v] for f in FLAGS}

    def latest(flag: str) -> Column:
        value = F.lit(None).cast("boolean")
        for a, v in sets[flag]:
            value = F.when(F.col("action") == a, F.lit(v)).otherwise(value)
        return F.max_by(value, F.when(value.isNotNull(), F.struct("at", "action"))).alias(f"n_{flag}")

    changes = good.groupBy(*KEY).agg(*(latest(f) for f in FLAGS), F.max_by("title", F.struct("at", "action")).alias("n_title"), F.max_by("author", F.struct("at", "action")).alias("n_author"), F.max("at").alias("n_at"))
    recs = _keyed(state.recommendations)
    first = recs.groupBy(*KEY).agg(F.min("id").alias("id"))
    hit = first.join(changes, list(KEY)).drop("_t", "_a", "format")
    updated = state.recommendations.join(hit, "id", "left").withColumns({f: F.coalesce(f"n_{f}", f) for f in FLAGS} | {"feedback_date": F.coalesce("n_at", "feedback_date")}).select(*state.recommendations.columns)
    fresh = changes.join(first.drop("id"), list(KEY), "left_anti").select(
        F.col("n_title").alias("title"), F.col("n_author").alias("author"), "format", F.lit("user_feedback").alias("recommendation_type"), F.col("n_at").alias("feedback_date"), now.alias("created_at"),
        *(F.col(f"n_{f}").alias(f) if f.startswith("thumbs") else F.coalesce(f"n_{f}", F.lit(False)).alias(f) for f in FLAGS),
    )
    rows = assign_ids(fresh, state.recommendations, F.col("author"), F.col("title"), F.col("format"))
    plan = hit.select("id", F.lit("update").alias("action")).unionByName(rows.select("id", F.lit("insert").alias("action")))
    return plan, state.with_(recommendations=updated.unionByName(rows, allowMissingColumns=True))


def set_hidden(state: LibraryState, names: DataFrame, hidden: bool, now: Column) -> tuple[DataFrame, LibraryState]:
    """Authors by lower name; plan: the names' matches (id null: no such author)."""
    wanted = names.select(X.lower_trim(F.col("name")).alias("_n")).distinct()
    plan = wanted.join(state.authors.select(F.lower("name").alias("_n"), "id"), "_n", "left").select(F.col("_n").alias("name"), "id")
    hit = plan.filter("id IS NOT NULL").select("id", F.lit(True).alias("_hit"))
    changed = state.authors.join(hit, "id", "left").withColumns({
        "hidden": F.when(F.col("_hit"), F.lit(hidden)).otherwise(F.col("hidden")),
        "hidden_at": F.when(F.col("_hit"), now if hidden else F.lit(None).cast("timestamp")).otherwise(F.col("hidden_at")),
    })
    return plan, state.with_(authors=changed)


def recategorize(state: LibraryState, picks: DataFrame) -> tuple[DataFrame, LibraryState]:
    """Picks (title, author): the author's catalog row of that title moves between fiction and non-fiction, and so
    do its recommendations. Authors are found by lower display name."""
    keys = _keyed(picks).select("_t", "_a").distinct()
    owners = state.authors.select(F.col("id").alias("author_id"), X.lower_trim(F.col("name")).alias("_a"))
    rows = state.catalog.withColumn("_t", X.lower_trim(F.col("title"))).join(owners, "author_id").join(keys, ["_t", "_a"], "left_semi")
    first = rows.groupBy("_t", "_a").agg(F.min_by(F.struct("id", "categories"), "id").alias("c"))
    plan = first.select("_t", "_a", F.col("c.id").alias("id"), F.col("c.categories").alias("old_categories"), F.array_join(C.toggled_categories(X.category_list(F.col("c.categories"))), ", ").alias("new_categories"))
    catalog = state.catalog.join(plan.select("id", "new_categories"), "id", "left").withColumn("categories", F.coalesce("new_categories", "categories"))
    recs = _keyed(state.recommendations).join(plan.select("_t", "_a", "new_categories"), ["_t", "_a"], "left").withColumn("category", F.coalesce("new_categories", "category"))
    return plan.select("id", "old_categories", "new_categories"), state.with_(catalog=catalog, recommendations=recs)
