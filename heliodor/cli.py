"""Command line: search, show, open, status, prune, sync and reset over a folder of tables. JSON by default, text with --human."""

from __future__ import annotations

import argparse
import json
import re
import sys
import webbrowser
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from heliodor.operators import embedding, resolve, retention, search, status
from heliodor.plans import sync
from heliodor.session import get_session, scratch


def parse_limit(value: str | int | None, default: int = 20) -> int:
    """The whole number a value begins with, or the default for nothing, zero and what begins with none."""
    found = re.match(r"\s*([+-]?\d+)", str(value))
    return int(found.group(1)) or default if found else default


def grouped(n: int) -> str:
    return f"{n:,}"


def table(title: str, heading: str, rows: dict[str, int]) -> str:
    """Counts in a frame, names to the left and numbers to the right."""
    wide, far = max([10, *map(len, rows)]), max([7, *(len(grouped(n)) for n in rows.values())])
    rule = "  " + "─" * (wide + far + 7)
    body = [f"  │ {name:<{wide}} │ {grouped(n):>{far}} │" for name, n in rows.items()]
    return "\n".join([f"{title}:", rule, f"  │ {heading:<{wide}} │ {'Count':>{far}} │", rule, *body, rule])


def status_text(held: dict) -> str:
    parts = ["=== Status ===", table("By Type", "Type", held["byType"]), table("By Status", "Status", held["byStatus"]), f"Total resources: {grouped(held['total'])}\nIndexed documents: {grouped(held['indexed'])}"]
    if held["recentFailures"]:
        parts.append("\n".join(["Recent failures:", *(f"  - {f['title'] or f['url']}" for f in held["recentFailures"])]))
    return "\n\n".join(parts)


def search_text(hits: list[dict]) -> str:
    lines = [f"{no}. {h['title']} [{h['type']}] {h['score']:.3f}\n   {h['url']}\n   {h['snippet']}" for no, h in enumerate(hits, 1)]
    return "\n\n".join(lines) or "No results found."


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser("heliodor")
    out.add_argument("--root", required=True)
    out.add_argument("--human", action="store_true")
    sub = out.add_subparsers(dest="command", required=True)
    s = sub.add_parser("search")
    s.add_argument("query")
    s.add_argument("--limit", default="20")
    s.add_argument("--type")
    s.add_argument("--keyword", action="store_true")
    s.add_argument("--semantic", action="store_true")
    for name in ("show", "open"):
        sub.add_parser(name).add_argument("ref")
    sub.add_parser("status")
    p = sub.add_parser("prune")
    p.add_argument("folder")
    p.add_argument("--dry-run", action="store_true")
    y = sub.add_parser("sync")
    y.add_argument("records", help="Parquet table of id, type, url, source, title and, without --store, payload, etag, content_hash")
    y.add_argument("--store", help="Parquet table of address, payload, etag")
    y.add_argument("--now", type=int, default=0, help="milliseconds")
    y.add_argument("--refresh-all", action="store_true")
    for stage in ("discover", "fetch", "normalize", "index"):
        y.add_argument(f"--{stage}-only", action="store_true")
    sub.add_parser("reset").add_argument("--confirm", action="store_true")
    return out


def main(argv: list[str] | None = None, ask: Callable[[str], str] = input, browse: Callable[[str], object] = webbrowser.open) -> int:
    args, spark = parser().parse_args(argv), get_session()
    with scratch():
        return run(spark, args, ask, browse)


def run(spark: SparkSession, args: argparse.Namespace, ask: Callable[[str], str], browse: Callable[[str], object]) -> int:
    told = None
    if args.command == "search":
        tables = [sync.open_table(spark, args.root, t) for t in ("content", "content_vec", "content_vec_map")]
        vector = embedding.hashing_embedder([args.query])[0].tolist()
        stored = sync.open_index(spark, args.root)
        rows = search.hybrid_search(*tables, args.query, vector, parse_limit(args.limit), args.type, args.keyword, args.semantic, stored.occurrences, sizes=stored.lengths)
        out = [r.asDict() for r in rows.orderBy(F.desc("score"), F.asc_nulls_last("fts_rank"), F.asc_nulls_last("vec_rank")).collect()]
        told = search_text(out)
    elif args.command in ("show", "open"):
        found = resolve.resolve(spark.createDataFrame([(args.ref,)], "ref string"), sync.open_table(spark, args.root, "manifest"))
        if args.command == "open":
            url = found.first()["url"]
            out, told = {"opened": url}, f"Opened {url}"
            if url:
                browse(url)
        else:
            out = [r.asDict() for r in resolve.show(found, sync.open_table(spark, args.root, "content")).orderBy("chunk_index").collect()]
            told, url = "\n\n".join(f"{r['title']}\n{r['body']}" for r in out), out
        if not url:
            print(json.dumps({"error": f"nothing found for {args.ref}"}), file=sys.stderr if args.command == "open" else sys.stdout)
            return 1
    elif args.command == "status":
        m, content = sync.open_table(spark, args.root, "manifest"), sync.open_table(spark, args.root, "content")
        out = {name: {r[c]: r["n"] for r in status.counts(m, c).orderBy(c).collect() if r[c] is not None} for name, c in (("byStatus", "status"), ("byType", "type"))}
        totals = status.totals(m, content).first()
        failed = m.where("status = 'failed'").select("url", "title").orderBy("url").limit(10)
        out |= {"total": totals["resources"], "indexed": totals["items"], "recentFailures": [r.asDict() for r in failed.collect()]}
        told = status_text(out)
    elif args.command == "sync":
        only = {stage: getattr(args, f"{stage}_only") for stage in ("discover", "fetch", "normalize", "index")}
        store = spark.read.parquet(args.store) if args.store else None
        out = sync.sync(spark, args.root, spark.read.parquet(args.records), only, store=store, refresh_all=args.refresh_all, now_ms=args.now)
        told = "\n".join(f"{stage}: {grouped(n)}" for stage, n in out.items())
    elif args.command == "reset":
        sure = args.confirm or ask('This will delete all tables. Type "confirm" to proceed: ').lower() == "confirm"
        out = {"reset": retention.reset(spark, args.root, sure)}
        told = "Reset complete." if sure else "Reset cancelled."
    else:
        out = retention.prune(spark, args.folder, args.dry_run)
        told = f"{grouped(out['files'])} files, {grouped(out['bytes'])} bytes"
    print(told if args.human else json.dumps(out, ensure_ascii=False, indent=1))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
