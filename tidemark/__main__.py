"""python -m tidemark: list and run queries over a folder of tables, tell the context of a signal, analyse failures."""

from __future__ import annotations

import argparse

from tidemark.operators import evaluate as V
from tidemark.plans.queries import QUERIES
from tidemark.plans.views import predictions, remedies
from tidemark.session import session
from tidemark.sources.reports import markdown


def main(args: list[str] | None = None) -> str:
    """What the command prints."""
    parser = argparse.ArgumentParser(prog="tidemark", description=__doc__)
    parser.add_argument("--master", default="local[*]")
    modes = parser.add_subparsers(dest="mode", required=True)
    modes.add_parser("list", help="names of the queries")
    run = modes.add_parser("run", help="a query, its first rows or all of it into a folder")
    run.add_argument("query", choices=sorted(QUERIES))
    run.add_argument("tables")
    run.add_argument("--rows", type=int, default=20)
    run.add_argument("--into", help="a folder that the whole result is written to as Parquet")
    context = modes.add_parser("context", help="everything about one incident signal")
    context.add_argument("tables")
    context.add_argument("signal", type=int)
    failures = modes.add_parser("failures", help="where score is lost, as Markdown")
    failures.add_argument("tables")
    a = parser.parse_args(args)
    if a.mode == "list":
        return "\n".join(f"{name}: {(q.__doc__ or '').strip().splitlines()[0] if q.__doc__ else ''}".rstrip(": ") for name, q in sorted(QUERIES.items()))
    spark = session(a.master)
    if a.mode == "run":
        out = QUERIES[a.query](spark, a.tables)
        if a.into:
            out.write.mode("errorifexists").parquet(a.into)
            return a.into
        return markdown(out, a.rows)
    if a.mode == "context":
        return markdown(QUERIES["q_context_full"](spark, a.tables).where(f"signal_id = {a.signal}"), 1)
    p, r = predictions(spark, a.tables), remedies(spark, a.tables)
    parts = {"Quality": V.quality(p, r), "Losses": V.loss_breakdown(p, r), "By family": V.loss_by_family(p, r), "Calibration": V.calibration(p), "Worst": V.top_failures(p, 10, r)}
    return "\n".join(f"## {head}\n\n{markdown(df)}" for head, df in parts.items())


if __name__ == "__main__":
    print(main())
