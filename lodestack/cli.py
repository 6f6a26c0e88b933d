"""Command line: stats, import-urls, harvest, index, extract, search, reextract over a knowledge base folder."""

from __future__ import annotations

import argparse

from lodestack.kb import KnowledgeBase
from lodestack.session import build_session
from lodestack.settings import Settings


def main(args: list[str] | None = None, spark=None) -> int:
    p = argparse.ArgumentParser(prog="lodestack")
    p.add_argument("--root", required=True, help="folder of the knowledge base")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("stats")
    sub.add_parser("reextract")
    imp = sub.add_parser("import-urls")
    imp.add_argument("path")
    imp.add_argument("--column")
    for name in ("harvest", "index"):
        c = sub.add_parser(name)
        c.add_argument("--batch", type=int)
    c.add_argument("--rebuild", action="store_true")
    sub.add_parser("extract").add_argument("--force", action="store_true")
    sub.add_parser("search").add_argument("question", nargs="+")
    a = p.parse_args(args)
    kb = KnowledgeBase(spark or build_session(), a.root, Settings.from_env())
    if a.command == "stats":
        for r in kb.stats().collect():
            print(f"{r.name}: {r.n_rows}")
    elif a.command == "import-urls":
        print(f"batch {kb.import_sheet(a.path, a.column)}")
    elif a.command == "harvest":
        kb.harvest(batch_id=a.batch)
    elif a.command == "index":
        kb.index(a.batch, a.rebuild)
    elif a.command == "extract":
        kb.extract(a.force)
    elif a.command == "reextract":
        kb.reextract()
    else:
        for r in kb.search(" ".join(a.question)).orderBy("page_rank").collect():
            print(r.note if r.url is None else f"{r.score:.4f} {r.title} {r.url}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
