"""Authors: duplicates, merges, mixed identities, groups, publishers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import text as X
from ..schema import LibraryState, assign_ids
from ..store import settle, settled


def duplicate_authors(state: LibraryState, min_overlap: int = 1) -> DataFrame:
    """Q7: pairs of authors with the same first and last name and common catalog titles."""
    parts = X.first_last(F.col("name"))
    a = state.authors.select("id", "name", "open_library_id", parts["first"].alias("_f"), parts["last"].alias("_l")).filter("_f <> '' AND _l <> ''")
    titles = state.catalog.select(F.col("author_id"), X.lower_trim(F.col("title")).alias("_t")).filter("_t <> ''").distinct()
    one = a.join(titles, a["id"] == titles["author_id"]).select("_f", "_l", "_t", F.col("id").alias("id1"), F.col("name").alias("name1"), F.col("open_library_id").alias("k1"))
    two = one.select("_f", "_l", "_t", F.col("id1").alias("id2"), F.col("name1").alias("name2"), F.col("k1").alias("k2"))
    both = one.join(two, ["_f", "_l", "_t"]).filter("id1 < id2").withColumn("_rn", F.row_number().over(Window.partitionBy("id1", "id2").orderBy("_t")))
    pairs = both.groupBy("id1", "id2", "name1", "name2", "k1", "k2").agg(F.count("*").alias("overlap"), F.array_sort(F.collect_list(F.when(F.col("_rn") <= 5, F.col("_t")))).alias("sample_titles"))
    same = F.coalesce(F.col("k1") == F.col("k2"), F.lit(False))
    high = same | (F.col("overlap") >= 3) | F.col("k1").isNotNull() | F.col("k2").isNotNull()
    return pairs.filter(F.col("overlap") >= min_overlap).select(
        "id1", "name1", "id2", "name2", "overlap", "sample_titles", F.when(high, "high").otherwise("medium").alias("confidence"),
        F.when(same, "same_open_library_id").otherwise("name_match_with_overlapping_books").alias("reason"),
    ).orderBy(F.when(F.col("confidence") == "high", 0).otherwise(1), F.desc("overlap"), "id1", "id2")


def resolve_author(state: LibraryState, who: str | int) -> DataFrame:
    """One author row by id, exact name, name or normalised name in any case, or part of the name; the
    smallest id of the first rule that finds any."""
    if isinstance(who, int):
        return state.authors.filter(F.col("id") == who)
    n = who.strip().lower()
    rank = F.when(F.col("name") == who, 1).when(F.lower("name") == n, 2).when(F.lower("normalized_name") == n, 3).when(F.contains(F.lower("name"), F.lit(n)), 4)
    return state.authors.withColumn("_rank", rank).filter("_rank IS NOT NULL").orderBy("_rank", "id").limit(1).drop("_rank")


def merge_authors(state: LibraryState, author1: str | int, author2: str | int, keep: str | int | None = None) -> tuple[DataFrame, LibraryState]:
    """Q6: two authors become one: the explicit one, else that with more catalog rows, else the only one with an outside
    id, else the first. Of the other's catalog rows, those whose title the kept one has go, the rest move; of its loans,
    those whose title or isbn the kept one has go. Loans stay untouched where both share one normalised name: they are
    the kept author's already. plan: keep_id, remove_id and, per table, ids with their action."""
    one, two = resolve_author(state, author1), resolve_author(state, author2)
    n = state.catalog.groupBy(F.col("author_id").alias("id")).agg(F.count("*").alias("_n"))
    both = one.withColumn("_side", F.lit(1)).unionByName(two.withColumn("_side", F.lit(2))).join(n, "id", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    if keep is not None:
        both = both.withColumn("_n", F.when(F.col("id").isin([r["id"] for r in resolve_author(state, keep).select("id").collect()]), 1 << 40).otherwise(F.col("_n")))
    ranked = both.orderBy(F.desc("_n"), F.when(F.col("open_library_id").isNotNull(), 0).otherwise(1), "_side").select("id", "name", "normalized_name", "open_library_id").collect()  # two rows
    if len(ranked) < 2 or ranked[0]["id"] == ranked[1]["id"]:
        raise ValueError("two different authors are needed")
    k, r = ranked
    titles = state.catalog.filter(F.col("author_id") == k["id"]).select(F.lower("title").alias("_t")).distinct()
    theirs = state.catalog.filter(F.col("author_id") == r["id"]).select("id", X.lower_trim(F.col("title")).alias("_t"))
    # Rows that move count as the kept author's for those after them.
    theirs = theirs.withColumn("_rn", F.row_number().over(Window.partitionBy("_t").orderBy("id"))).join(titles.withColumn("_has", F.lit(True)), "_t", "left")
    cat = theirs.select("id", F.lit("catalog").alias("table"), F.when(F.col("_has") | (F.col("_rn") > 1), "delete").otherwise("move").alias("action"))
    plan = cat
    if k["normalized_name"] != r["normalized_name"]:
        mine = state.books.filter(F.col("author") == k["normalized_name"])
        mine_t = mine.select(X.lower_trim(F.col("title")).alias("_t")).distinct().withColumn("_ht", F.lit(True))
        mine_i = mine.filter("isbn <> ''").select("isbn").distinct().withColumn("_hi", F.lit(True))
        loans = state.books.filter(F.col("author") == r["normalized_name"]).select("id", "isbn", X.lower_trim(F.col("title")).alias("_t"))
        again = F.row_number().over(Window.partitionBy("_t").orderBy("id")) > 1
        again_i = (F.col("isbn") != "") & (F.row_number().over(Window.partitionBy("isbn").orderBy("id")) > 1)
        loans = loans.withColumns({"_again": again, "_again_i": F.coalesce(again_i, F.lit(False))}).join(mine_t, "_t", "left").join(mine_i, "isbn", "left")
        plan = plan.unionByName(loans.select("id", F.lit("books").alias("table"), F.when(F.col("_ht") | F.col("_hi") | F.col("_again") | F.col("_again_i"), "delete").otherwise("move").alias("action")))
    plan = plan.withColumns({"keep_id": F.lit(k["id"]), "remove_id": F.lit(r["id"])})

    def applied(df: DataFrame, name: str, column: str, value) -> DataFrame:
        acts = plan.filter(F.col("table") == name).select("id", "action")
        return df.join(acts, "id", "left").filter("action IS NULL OR action <> 'delete'").withColumn(column, F.when(F.col("action") == "move", F.lit(value)).otherwise(F.col(column)))

    authors = state.authors.filter(F.col("id") != r["id"]).withColumn("open_library_id", F.when(F.col("id") == k["id"], F.coalesce("open_library_id", F.lit(r["open_library_id"]))).otherwise(F.col("open_library_id")))
    return plan, state.with_(authors=authors, catalog=applied(state.catalog, "catalog", "author_id", k["id"]), books=applied(state.books, "books", "author", k["normalized_name"]))


def mixed_identities(state: LibraryState, work_authors: DataFrame) -> DataFrame:
    """Authors whose catalog rows come from several outside authors. work_authors: key (of the work), author_key
    (its first author). Gives author_id, author_key, books, catalog_ids."""
    rows = state.catalog.join(work_authors.select(F.col("key").alias("open_library_key"), "author_key"), "open_library_key")
    g = rows.groupBy("author_id", "author_key").agg(F.count("*").alias("books"), F.array_sort(F.collect_list("id")).alias("catalog_ids"))
    return g.withColumn("keys", F.count("*").over(Window.partitionBy("author_id"))).filter("keys > 1").drop("keys")


def fix_mismatches(
    state: LibraryState, work_authors: DataFrame, author_works: DataFrame, names: DataFrame, now: Column, limit: int | None = None, only_cataloged: bool = False
) -> tuple[DataFrame, LibraryState]:
    """Q8: first authors whose rows come from several outside authors, then authors of one normalised name. limit: so many
    authors with two catalog rows or more are looked at, by id; what is left of it after those that were mixed bounds the
    names. only_cataloged: names of which an author has a catalog. plan: step, author_id, to_id and the row it concerns."""
    many = state.catalog.groupBy("author_id").agg(F.count("*").alias("n")).filter("n > 1").select("author_id")
    scope = many if limit is None else many.orderBy("author_id").limit(limit)
    found = settled(work_authors.join(state.catalog.join(scope, "author_id", "left_semi").select(F.col("open_library_key").alias("key")).distinct(), "key", "left_semi"))
    first, mid = fix_mixed_identities(state, found, author_works, names, now, settled(scope))
    first, mid = settled(first), settle(mid)
    mixed = first.select("author_id").distinct().count()
    plan = first.select(F.lit("identity").alias("step"), "author_id", "to_id", F.explode("catalog_ids").alias("id"), F.lit("move").alias("action"))
    if limit is not None and mixed >= limit:
        return plan, mid
    second, new = fix_duplicate_names(mid, author_works, None if limit is None else limit - mixed, only_cataloged, state.authors.select("id"))
    return plan.unionByName(second.select(F.lit("name").alias("step"), "author_id", "to_id", "id", "action")), new


def fix_mixed_identities(state: LibraryState, work_authors: DataFrame, author_works: DataFrame, names: DataFrame, now: Column, scope: DataFrame | None = None) -> tuple[DataFrame, LibraryState]:
    """Q8, first part (of the authors in scope, if given): an author's rows stay with the outside author whose works best match the loans (10 for each work
    read, 5 for each catalog title read; without any, the most rows); the rows of others move to an author of that
    outside id, of that name, or a new one. author_works: author_key, title; names: author_key, name."""
    mixed = mixed_identities(state, work_authors)
    mixed = settled(mixed if scope is None else mixed.join(scope, "author_id", "left_semi"))
    lists, mixed = mixed.select("author_id", "author_key", "catalog_ids"), mixed.drop("catalog_ids")  # lists stay out of the joins
    loans = state.books.select(F.col("author").alias("normalized_name"), X.lower_trim(F.col("title")).alias("_t")).distinct()
    owners = state.authors.select(F.col("id").alias("author_id"), "normalized_name", F.col("name").alias("own_name"))
    base = mixed.join(owners, "author_id")
    w = base.select("author_id", "normalized_name", "author_key").join(author_works.select("author_key", X.lower_trim(F.col("title")).alias("_t")), "author_key").join(loans, ["normalized_name", "_t"], "left_semi").groupBy("author_id", "author_key").agg((10 * F.count("*")).alias("_w"))
    c = lists.select("author_id", "author_key", F.explode("catalog_ids").alias("id")).join(owners.select("author_id", "normalized_name"), "author_id").join(state.catalog.select("id", X.lower_trim(F.col("title")).alias("_t")), "id").join(loans, ["normalized_name", "_t"], "left_semi").groupBy("author_id", "author_key").agg((5 * F.count("*")).alias("_c"))
    scored = base.join(w, ["author_id", "author_key"], "left").join(c, ["author_id", "author_key"], "left").withColumn("score", F.coalesce("_w", F.lit(0)) + F.coalesce("_c", F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("author_id").orderBy(F.desc("score"), F.desc("books"), "author_key"))
    others = scored.withColumn("rank", rank).filter("rank > 1").join(names.select("author_key", F.col("name").alias("outside_name")), "author_key", "left").withColumn("target", F.coalesce("outside_name", "own_name"))
    by_key = state.authors.filter("open_library_id IS NOT NULL").groupBy(F.col("open_library_id").alias("author_key")).agg(F.min("id").alias("_i1"))
    by_name = state.authors.groupBy(F.col("name").alias("target")).agg(F.min("id").alias("_i2"))
    placed = others.join(by_key, "author_key", "left").join(by_name, "target", "left").withColumn("to_id", F.coalesce("_i1", "_i2"))
    new = assign_ids(placed.filter("to_id IS NULL").groupBy("target").agg(F.min("author_key").alias("open_library_id"), F.min_by("normalized_name", "author_id").alias("normalized_name")), state.authors, F.col("target"), F.col("open_library_id")).select("id", F.col("target").alias("name"), "normalized_name", "open_library_id", now.alias("created_at"))
    plan = placed.join(new.select(F.col("name").alias("target"), F.col("id").alias("_new")), "target", "left").select("author_id", "author_key", "score", F.coalesce("to_id", "_new").alias("to_id"), "target")
    plan = plan.join(lists, ["author_id", "author_key"]).select("author_id", "author_key", "score", "to_id", "target", "catalog_ids")
    moves = plan.select(F.explode("catalog_ids").alias("id"), "to_id")
    catalog = state.catalog.join(moves, "id", "left").withColumn("author_id", F.coalesce("to_id", "author_id"))
    return plan, state.with_(catalog=catalog, authors=state.authors.unionByName(new, allowMissingColumns=True))


def pick_candidates(found: DataFrame, works: DataFrame, books: DataFrame, first_works: int = 20) -> DataFrame:
    """Of an author's search results (author, rank, author_key) the first with one of the titles read among its first
    works (author_key, pos, title), else the first result. books: the loans, by author. Gives author, author_key, certain."""
    keyed = found.filter("author_key <> ''").select("author", "rank", X.author_key(F.col("author_key")).alias("author_key"))
    some = works.filter(F.col("pos") < first_works).select(X.author_key(F.col("author_key")).alias("author_key"), X.lower_trim(F.col("title")).alias("_t")).distinct()
    read = books.select("author", X.lower_trim(F.col("title")).alias("_t")).distinct()
    hits = keyed.join(some, "author_key").join(read, ["author", "_t"], "left_semi").select("author", "author_key").distinct().withColumn("_hit", F.lit(True))
    rows = keyed.join(hits, ["author", "author_key"], "left").withColumn("certain", F.coalesce("_hit", F.lit(False)))
    return rows.groupBy("author").agg(F.min(F.struct((~F.col("certain")).alias("u"), "rank", "author_key", "certain")).alias("m")).select("author", "m.author_key", "m.certain")


def fix_duplicate_names(state: LibraryState, author_works: DataFrame, limit: int | None = None, only_cataloged: bool = False, known: DataFrame | None = None) -> tuple[DataFrame, LibraryState]:
    """Q8, second part: of authors with one normalised name, that whose outside works (10 each) and catalog titles (5
    each) best match the loans of the name takes the others' catalog rows; rows whose title it has go. Names without
    loans or without any match stay as they are; authors left without a catalog go. plan: author_id, to_id, id, action.
    limit: so many names, in order; only_cataloged: names of which an author has a catalog; known: ids of the authors that
    are looked at (all, if None)."""
    looked_at = state.authors if known is None else state.authors.join(known, "id", "left_semi")
    many = looked_at.withColumn("_n", F.count("*").over(Window.partitionBy("normalized_name"))).filter("_n > 1").select(F.col("id").alias("author_id"), "normalized_name", X.author_key(F.col("open_library_id")).alias("author_key"))
    if only_cataloged:
        many = many.join(many.join(state.catalog.select("author_id").distinct(), "author_id", "left_semi").select("normalized_name").distinct(), "normalized_name", "left_semi")
    if limit is not None:
        many = many.join(many.select("normalized_name").distinct().orderBy("normalized_name").limit(limit), "normalized_name", "left_semi")
    loans = state.books.select(F.col("author").alias("normalized_name"), X.lower_trim(F.col("title")).alias("_t")).distinct()
    w = many.join(author_works.select(X.author_key(F.col("author_key")).alias("author_key"), X.lower_trim(F.col("title")).alias("_t")), "author_key").join(loans, ["normalized_name", "_t"], "left_semi").select("author_id", F.lit(10).alias("points"))
    rows = state.catalog.select("id", "author_id", X.lower_trim(F.col("title")).alias("_t")).join(many.select("author_id", "normalized_name"), "author_id")
    c = rows.join(loans, ["normalized_name", "_t"], "left_semi").select("author_id", F.lit(5).alias("points"))
    score = w.unionByName(c).groupBy("author_id").agg(F.sum("points").alias("score"))
    best = many.join(score, "author_id").groupBy("normalized_name").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("author_id").alias("to_id"))).alias("m")).select("normalized_name", "m.to_id")
    moved = rows.join(best, "normalized_name").filter("author_id <> to_id")
    own = rows.join(best, "normalized_name").filter("author_id = to_id").select("to_id", "_t").distinct().withColumn("_has", F.lit(True))
    again = F.row_number().over(Window.partitionBy("to_id", "_t").orderBy("id")) > 1
    plan = moved.withColumn("_again", again).join(own, ["to_id", "_t"], "left").select("author_id", "to_id", "id", F.when(F.col("_has") | F.col("_again"), "delete").otherwise("move").alias("action"))
    catalog = state.catalog.join(plan.select("id", "to_id", "action"), "id", "left").filter("action IS NULL OR action <> 'delete'").withColumn("author_id", F.coalesce("to_id", "author_id"))
    others = many.join(best, "normalized_name").filter("author_id <> to_id").select(F.col("author_id").alias("id"))
    return plan, state.with_(catalog=catalog, authors=state.authors.join(others, "id", "left_anti"))


def split_groups(state: LibraryState, names: DataFrame | None = None, manual: bool = False) -> tuple[DataFrame, LibraryState]:
    """Q10: authors that are comma lists of names are taken apart. A catalog row goes to the member that the title map
    gives (names: title, author_name), else to one whose last name is in the title, else to the first (manual: rows
    without any stay). Loans go the same way, by the group's normalised name. The group goes when nothing is left.
    plan: table, id, member, how."""
    groups = state.authors.withColumn("members", X.author_group(F.col("name"))).filter("members IS NOT NULL").select(F.col("id").alias("group_id"), F.col("normalized_name").alias("group_name"), F.lower("name").alias("group_display"), "members")
    rows = state.catalog.join(groups, state.catalog["author_id"] == groups["group_id"]).select(F.lit("catalog").alias("table"), "id", "title", "members", "group_id")
    loans = state.books.join(groups, state.books["author"] == groups["group_name"]).select(F.lit("books").alias("table"), "id", "title", "members", "group_id")
    recs = state.recommendations.withColumn("_l", F.lower("author"))
    recs = recs.join(groups, recs["_l"] == groups["group_display"]).select(F.lit("recommendations").alias("table"), recs["id"], "title", "members", "group_id")
    every = (rows.unionByName(loans).unionByName(recs) if manual else rows.unionByName(loans)).withColumn("_t", X.lower_trim(F.col("title")))
    if names is not None:
        known = names.select(X.lower_trim(F.col("title")).alias("_t"), F.lower("author_name").alias("_n")).groupBy("_t").agg(F.collect_set("_n").alias("_names"))
        every = every.join(known, "_t", "left")
    else:
        every = every.withColumn("_names", F.lit(None).cast("array<string>"))
    least = 2 if manual else 1
    by_map = F.get(F.filter("members", lambda m: F.coalesce(F.array_contains("_names", F.lower(m)), F.lit(False))), F.lit(0))
    last = lambda m: F.lower(F.element_at(F.split(m, " "), -1))
    by_last = F.get(F.filter("members", lambda m: (F.size(F.split(m, " ")) >= least) & F.contains(F.col("_t"), last(m))), F.lit(0))
    first = F.lit(None).cast("string") if manual else F.get("members", F.lit(0))
    plan = every.select("table", "id", "group_id", F.coalesce(by_map, by_last, first).alias("member"), F.when(by_map.isNotNull(), "titles").when(by_last.isNotNull(), "last_name").otherwise("first").alias("how")).filter("member IS NOT NULL")
    members = plan.select(F.col("member").alias("name")).unionByName(groups.select(F.explode("members").alias("name"))).distinct()
    new = assign_ids(members.join(state.authors.select("name"), "name", "left_anti"), state.authors, F.col("name"), F.col("name")).withColumn("normalized_name", X.author_name(F.col("name")))
    authors = state.authors.unionByName(new.withColumn("hidden", F.lit(False)), allowMissingColumns=True)
    ids = authors.groupBy(F.col("name").alias("member")).agg(F.min("id").alias("_to"))
    to = plan.join(ids, "member")
    catalog = state.catalog.join(to.filter(F.col("table") == "catalog").select("id", "_to"), "id", "left").withColumn("author_id", F.coalesce("_to", "author_id"))
    books = state.books.join(to.filter(F.col("table") == "books").select("id", X.author_name(F.col("member")).alias("_name")), "id", "left").withColumn("author", F.coalesce("_name", "author"))
    named = state.recommendations.join(to.filter(F.col("table") == "recommendations").select("id", F.col("member").alias("_member")), "id", "left").withColumn("author", F.coalesce("_member", "author"))
    left = catalog.select(F.col("author_id").alias("id")).distinct()
    empty = groups.select(F.col("group_id").alias("id")).join(left, "id", "left_anti")
    return plan, state.with_(authors=authors.join(empty, "id", "left_anti"), catalog=catalog, books=books, recommendations=named)


def publisher_authors(state: LibraryState, many: int = 50, samples: int = 5) -> DataFrame:
    """Authors that look like publishers, with their label, and others with more than `many` catalog rows."""
    ranked = state.catalog.select(F.col("author_id").alias("id"), "title", F.row_number().over(Window.partitionBy("author_id").orderBy(F.asc_nulls_last("title"))).alias("_rn"))
    c = ranked.groupBy("id").agg(F.count("*").alias("catalog_books"), F.array_sort(F.collect_list(F.when(F.col("_rn") <= samples, F.col("title")))).alias("sample_titles"))
    rows = state.authors.join(c, "id", "left").withColumns({"catalog_books": F.coalesce("catalog_books", F.lit(0)), "_p": C.is_publisher(F.col("name"))})
    return rows.filter(F.col("_p") | (F.col("catalog_books") > many)).select("id", "name", F.when(F.col("_p"), C.publisher_label(F.col("name"))).otherwise("Many books").alias("label"), "catalog_books", F.coalesce("sample_titles", F.array().cast("array<string>")).alias("sample_titles")).orderBy("label", F.desc("catalog_books"), "id")


def name_mismatches(state: LibraryState, least: float = 0.3) -> DataFrame:
    """Authors with a catalog whose display and normalised names have few words in common (both of several
    distinct words)."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(X.squeeze(X.or_empty(F.col(c)))), " "), lambda w: w != ""))
    a, b = words("name"), words("normalized_name")
    c = state.catalog.groupBy(F.col("author_id").alias("id")).agg(F.count("*").alias("catalog_books"))
    overlap = F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))
    return state.authors.join(c, "id").filter((F.size(a) > 1) & (F.size(b) > 1) & (overlap < least)).select("id", "name", "normalized_name", X.author_name(F.col("name")).alias("fixed_name"), overlap.alias("overlap"), "catalog_books").orderBy(F.desc("catalog_books"), "id")


def fix_name_mismatches(state: LibraryState, least: float = 0.3) -> tuple[DataFrame, LibraryState]:
    plan = name_mismatches(state, least)
    authors = state.authors.join(plan.select("id", "fixed_name"), "id", "left").withColumn("normalized_name", F.coalesce("fixed_name", "normalized_name"))
    return plan, state.with_(authors=authors)


def remove_authors(state: LibraryState, names: list[str], substring: bool = False) -> tuple[DataFrame, LibraryState]:
    """Authors by lower display or normalised name (or part of it), with their catalog rows, loans and
    recommendations. plan: table, id."""
    wanted = state.spark.createDataFrame([(n.strip().lower(),) for n in names], "_n string")
    ln, lm = F.lower("name"), F.lower("normalized_name")
    hit = (F.contains(ln, F.col("_n")) | F.contains(lm, F.col("_n"))) if substring else ((ln == F.col("_n")) | (lm == F.col("_n")))
    gone = state.authors.join(F.broadcast(wanted), hit, "left_semi")  # the names given by the caller are few
    c = state.catalog.join(gone.select(F.col("id").alias("author_id")), "author_id", "left_semi")
    b = state.books.join(gone.select(F.col("normalized_name").alias("author")), "author", "left_semi")
    r = state.recommendations.withColumn("_l", F.lower("author")).join(gone.select(F.lower("name").alias("_l")), "_l", "left_semi")
    plan = gone.select(F.lit("authors").alias("table"), "id")
    for name, df in (("catalog", c), ("books", b), ("recommendations", r)):
        plan = plan.unionByName(df.select(F.lit(name).alias("table"), "id"))
    return plan, state.with_(**{t: getattr(state, t).join(plan.filter(F.col("table") == t).select("id"), "id", "left_anti") for t in ("authors", "catalog", "books", "recommendations")})


def reassign_author(state: LibraryState, source: str | int, target: str | int) -> tuple[DataFrame, LibraryState]:
    """Q31: all catalog rows, loans and recommendations of one author go to another; the source's normalised name is
    made anew from its display name. plan: table, id."""
    s, t = resolve_author(state, source).first(), resolve_author(state, target).first()
    if s is None or t is None or s["id"] == t["id"]:
        raise ValueError("two different authors are needed")
    of = {"catalog": F.col("author_id") == s["id"], "books": F.col("author") == s["normalized_name"], "recommendations": F.lower("author") == s["name"].lower()}
    to = {"catalog": ("author_id", t["id"]), "books": ("author", t["normalized_name"]), "recommendations": ("author", t["name"])}
    plan, tables = None, {}
    for name, cond in of.items():
        df = getattr(state, name)
        part = df.filter(cond).select(F.lit(name).alias("table"), "id")
        plan = part if plan is None else plan.unionByName(part)
        column, value = to[name]
        tables[name] = df.withColumn(column, F.when(cond, F.lit(value)).otherwise(F.col(column)))
    authors = state.authors.withColumn("normalized_name", F.when(F.col("id") == s["id"], X.author_name(F.col("name"))).otherwise(F.col("normalized_name")))
    return plan, state.with_(authors=authors, **tables)
