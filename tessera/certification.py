"""Command line for certificates, the exported model, and proposals: python -m tessera.certification COMMAND."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence
from datetime import datetime
from pathlib import Path

from tessera import catalog
from tessera.decisions import calibration, context, proposals
from tessera.decisions.ledger import Ledger
from tessera.errors import Refusal
from tessera.metrics import certify, compiler
from tessera.metrics.kernel import load
from tessera.session import session


def _kernel(a):
    return load(json.loads(Path(a.kernel).read_text())) if a.kernel else catalog.kernel()


def _certify(a) -> int:
    """Run the golden requests {metric: [{request, expected}]} and write certificates."""
    spark, k = session(), _kernel(a)
    contract = catalog.contract(a.data)
    run = lambda m, request: compiler.compile_metric(k, lambda t: contract.table(spark, t), m, **request).df
    made = [certify.certify(k, run, m, golden) for m, golden in sorted(json.loads(Path(a.golden).read_text()).items())]
    Path(a.out).write_text(json.dumps(made, indent=2, sort_keys=True, default=str))
    return int(not all(c["passed"] for c in made))


def _verify(a) -> int:
    """Name the metrics whose certificate failed or is for another definition."""
    found = sorted(certify.stale(_kernel(a), json.loads(Path(a.certificates).read_text())))
    print(json.dumps({"stale": found}))
    return int(bool(found))


def _export(a) -> int:
    """Write the semantic model with the terms of a file, trust overrides of a ledger applied."""
    k = _kernel(a)
    lowered = proposals.overrides(Ledger(session(), a.ledger)) if a.ledger else None
    terms = context.load_terms(json.loads(Path(a.terms).read_text()) if a.terms else {}, k, lowered)
    Path(a.out).write_text(json.dumps(context.export_model(k, terms), indent=2, sort_keys=True, default=str))
    return 0


def _propose(a) -> int:
    """Record proposals from a table of scored decisions (term, delta)."""
    spark = session()
    by_term = calibration.aggregate(spark.read.parquet(a.scored), "term")
    print(json.dumps({"proposals": proposals.propose(Ledger(spark, a.ledger), by_term, datetime.now(), min_n=a.min_n, threshold=a.threshold)}))
    return 0


def _decide(verdict: str):
    def run(a) -> int:
        print(json.dumps({"recorded": proposals.decide(Ledger(session(), a.ledger), a.proposal_id, verdict, a.operator, datetime.now())}))
        return 0

    return run


def main(argv: Sequence[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tessera.certification")
    commands = p.add_subparsers(required=True)

    def command(name: str, run, *required: str, **optional):
        c = commands.add_parser(name, help=run.__doc__)
        for x in required:
            c.add_argument(x if x == "proposal_id" else f"--{x}", **({} if x == "proposal_id" else {"required": True}))
        for x, default in optional.items():
            c.add_argument(f"--{x.replace('_', '-')}", default=default, type=type(default) if default is not None else str)
        c.set_defaults(run=run)

    command("certify", _certify, "data", "golden", "out", kernel=None)
    command("verify", _verify, "certificates", kernel=None)
    command("export", _export, "out", terms=None, ledger=None, kernel=None)
    command("propose", _propose, "scored", "ledger", min_n=10, threshold=0.2)
    command("approve", _decide("approved"), "proposal_id", "ledger", operator="operator")
    command("reject", _decide("rejected"), "proposal_id", "ledger", operator="operator")
    a = p.parse_args(argv)
    try:
        return a.run(a)
    except Refusal as e:
        print(json.dumps(e.as_dict(), default=str))
        return 1


if __name__ == "__main__":
    sys.exit(main())
