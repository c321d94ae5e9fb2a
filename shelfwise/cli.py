"""Command line: python -m shelfwise.cli --db PATH COMMAND. Commands that change a library publish a new version; with
--dry-run they print the plan only. Commands that delete or move rows ask first, unless --yes is given."""

from __future__ import annotations

import argparse
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import authors, catalog, curation, dedupe, feedback, fetch, ingest, recommend, report, series
from .session import get_session
from .sources import DocumentClient, newest, read_approvals, read_editions_from, read_loans, read_report, read_works_from
from .sources.documents import Limits
from .store import SnapshotStore

#: Commands that ask before they change a library.
ASKS = ("cleanup", "fix-authors", "remove-duplicates", "merge-authors", "composites", "childrens", "consolidate-series", "approve", "reassign", "filter-books", "remove-authors", "split-groups")


def _numbers(text: str) -> list[int]:
    return [int(x) for x in text.replace(",", " ").split()]


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="shelfwise")
    p.add_argument("--db", default="library", help="folder of the library's versions")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *flags: str, **options):
        c = sub.add_parser(name)
        for f in flags:
            c.add_argument(f"--{f}", action="store_true")
        for o, kind in options.items():
            c.add_argument(f"--{o.replace('_', '-')}", type=kind, default=None)
        return c

    network = {"host": str, "volumes_host": str, "cache": str, "pause": float}
    command("ingest", "update").add_argument("csv")
    command("catalog", "force", "only-recent", "auto-cleanup", "yes", "list-due", recent_years=int, works=str, editions=str, **network)
    command("series", format=str)
    command("recommend", "save", category=str).add_argument("kind", choices=("audiobook", "ebook"))
    command("status")
    command("cleanup", "yes", "dry-run", "titles-only", limit=int, offset=int, **network)
    command("fix-authors", "yes", "dry-run", "only-cataloged", limit=int, **network)
    command("fix-names", "dry-run")
    command("remove-duplicates", "yes", "dry-run", limit=int, offset=int)
    command("merge-authors", "yes", "dry-run", author1=str, author2=str, author1_id=int, author2_id=int, keep=str)
    command("list-authors", search=str)
    for name in ("composites", "childrens", "consolidate-series"):
        command(name, "yes", "dry-run", keep=_numbers)
    command("verify-cleanup", limit=int, offset=int)
    command("review-cleanup")
    command("duplicates", author=str, min_books=int).add_argument("what", choices=("recommendations", "catalog", "prolific"))
    command("approve", "yes", "dry-run", "all", file=str, author_ids=_numbers, groups=str).add_argument("report")
    command("reassign", "yes", "dry-run", source=str, target=str, source_id=int, target_id=int)
    command("filter-books", "yes", "dry-run", author_id=int, patterns=str)
    command("publisher-authors", samples=int)
    command("remove-authors", "yes", "dry-run", "substring", names=str)
    command("extract-series", "dry-run", limit=int, offset=int)
    command("split-groups", "yes", "dry-run", names=str)
    command("standalone")
    command("audit", author_id=int)
    command("inspect", top=int)
    f = command("feedback", "dry-run")
    f.add_argument("format")
    f.add_argument("action", choices=tuple(feedback.ACTIONS))
    f.add_argument("title")
    f.add_argument("author")
    return p


def show(df: DataFrame, n: int = 20) -> None:
    df.show(n, truncate=80)


def confirmed(args: argparse.Namespace) -> bool:
    if args.command not in ASKS or args.yes or args.dry_run:
        return True
    return input("Continue? (yes/no): ").strip().lower() in ("yes", "y")


def _client(spark, args: argparse.Namespace) -> DocumentClient:
    limits = Limits() if args.pause is None else Limits(pause=args.pause)
    return DocumentClient(spark, args.cache or os.path.join(args.db, "cache"), limits)


def main(argv: list[str] | None = None) -> None:
    args = _parser().parse_args(argv)
    spark = get_session()
    store = SnapshotStore(spark, args.db)
    state, now = store.load(), F.current_timestamp()
    plan = None
    match args.command:
        case "ingest":
            plan, state = ingest.ingest(state, read_loans(spark, newest(spark, args.csv)), now, args.update)
        case "catalog":
            now = F.lit(spark.range(1).select(F.current_timestamp()).first()[0])  # one time for all steps
            years = (args.recent_years or 3) if args.only_recent else None
            if args.list_due:
                show(catalog.due_authors(state, now, args.force).filter("due"))
            else:
                if args.works:  # documents that were fetched before
                    works, editions = read_works_from(spark, args.works), read_editions_from(spark, args.editions or args.works)
                else:  # groups are taken apart first, as their members are what is looked for
                    state = catalog.split_first(state)
                    works, editions, keys = fetch.catalog_documents(_client(spark, args), args.host or fetch.WORKS, state, now, args.force)
                    state = catalog.with_author_keys(state, keys)
                plan, state = catalog.fetch_all(state, works, editions, now, args.force, years, args.auto_cleanup)
                show(authors.duplicate_authors(state))
        case "series":  # --format is accepted and has no effect
            show(series.analyze_series(state).limit(10))
            show(series.series_summary(state))
        case "recommend":
            recs = recommend.candidates(state, args.kind, args.category if args.kind == "ebook" else None)
            show(recs.orderBy(F.desc("similarity_score"), "author", "title"))
            if args.save:
                plan, state = recommend.save(state, recs, now)
        case "status":
            show(report.status(state, now))
        case "cleanup":
            parts = volumes = None
            if not args.titles_only:
                ids = catalog.sliced(state.catalog, args.limit, args.offset or 0).select("id") if args.limit or args.offset else None
                parts, volumes = fetch.language_documents(_client(spark, args), args.host or fetch.WORKS, args.volumes_host or fetch.VOLUMES, state, ids)
            plan, state = catalog.cleanup_non_english(state, args.limit, args.offset or 0, editions=parts, volumes=volumes)
        case "fix-authors":
            found = fetch.mismatch_documents(_client(spark, args), args.host or fetch.WORKS, state)
            plan, state = authors.fix_mismatches(state, *found, now, args.limit, args.only_cataloged)
        case "fix-names":
            plan, state = authors.fix_name_mismatches(state)
        case "remove-duplicates":
            plan, state = catalog.remove_duplicate_titles(state, args.limit, args.offset or 0)
        case "merge-authors":
            one, two = args.author1_id or args.author1, args.author2_id or args.author2
            if one is None and two is None:
                show(authors.duplicate_authors(state))
            elif one is None or two is None or isinstance(one, int) != isinstance(two, int):
                raise SystemExit("two names or two ids are needed")
            else:
                keep = one if args.keep in ("1", "author1", "first") else two if args.keep in ("2", "author2", "second") else args.keep
                plan, state = authors.merge_authors(state, one, two, keep)
        case "list-authors":
            show(report.list_authors(state, args.search), 1000)
        case "composites":
            listed = curation.numbered_composites(state)
            show(listed)
            plan, state = curation.remove_composites(state, keep_numbers=args.keep)
        case "childrens":
            listed = curation.childrens_books(state)
            show(curation.numbered(listed))
            plan, state = curation.delete_rows(state, listed, args.keep)
        case "consolidate-series":
            listed = series.numbered(series.consolidations(state))
            show(listed)
            plan, state = series.consolidate(state, without=args.keep)
        case "verify-cleanup":
            show(curation.verify_cleanup(state, args.limit, args.offset or 0))
        case "review-cleanup":
            show(report.histogram(curation.cleanup_review(state), "reasons"))
        case "duplicates":
            least = {"recommendations": 10, "catalog": 10, "prolific": 100}[args.what] if args.min_books is None else args.min_books
            if args.what == "prolific":
                show(dedupe.prolific_report(state, least))
            else:
                rows = state.catalog if args.what == "catalog" else state.recommendations
                groups = dedupe.catalog_duplicates(state, least) if args.what == "catalog" else dedupe.recommendation_duplicates(state, least, args.author)
                show(dedupe.explained(groups, rows))
        case "approve":
            given = read_approvals(spark, args.file).first() if args.file else None
            chosen = {"author_ids": args.author_ids, "group_keys": args.groups.split("|") if args.groups else None, "approve_all": args.all}
            if given is not None:
                chosen = {"author_ids": given["author_ids"], "group_keys": given["group_keys"], "approve_all": bool(given["approve_all"])}
            plan, state = dedupe.approve(state, read_report(spark, args.report), **chosen)
        case "reassign":
            source, target = args.source_id or args.source, args.target_id or args.target
            if source is None or target is None:
                raise SystemExit("a source and a target are needed")
            plan, state = authors.reassign_author(state, source, target)
        case "filter-books":
            chosen = {} if args.patterns is None else {"patterns": tuple(args.patterns.split("|"))}
            plan, state = curation.filter_books(state, args.author_id, **chosen)
        case "publisher-authors":
            show(authors.publisher_authors(state, samples=args.samples or 5), 1000)
        case "remove-authors":
            if not args.names:
                raise SystemExit("names, parted by |, are needed")
            plan, state = authors.remove_authors(state, args.names.split("|"), args.substring)
        case "extract-series":
            plan, state = series.extract_series(state, args.limit, args.offset or 0)
        case "split-groups":  # named groups are taken apart whatever their form
            names = None if args.names is None else spark.createDataFrame([(n,) for n in args.names.split("|")], "name string")
            plan, state = authors.split_groups(state, names, manual=names is not None)
        case "standalone":
            show(series.standalone_unread(state).orderBy("author", "title"), 1000)
        case "audit":
            show(dedupe.audit_author(state, args.author_id).filter("look_at"), 1000)
        case "inspect":
            show(report.inspect(state))
            show(report.top_authors(state, limit=args.top or 10))
        case "feedback":
            event = spark.range(1).select(F.lit(args.title).alias("title"), F.lit(args.author).alias("author"), F.lit(args.format).alias("format"), F.lit(args.action).alias("action"), now.alias("at"))
            plan, state = feedback.apply_feedback(state, event, now)
    if plan is not None:
        show(plan)
        if getattr(args, "dry_run", False):
            return
        if confirmed(args):
            print("version", store.publish(state))
        else:
            print("Cancelled.")


if __name__ == "__main__":
    main()
