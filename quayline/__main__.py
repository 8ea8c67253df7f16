"""python -m quayline build FOLDER ROOT
python -m quayline check FOLDER [--output FILE] [--fail-on-critical] [--baseline FILE [--tolerance PERCENT] [--update-baseline]]
python -m quayline train ROOT MODEL [--version NAME] [--permutations N] [--rounds N] [--card FILE]
python -m quayline monitor ROOT MODEL (--from DATE [--to DATE] | --last-days N) [--output FILE]

Exit code 0; 1 where the contract, a critical check that counts, or the gate fails; 2 for inputs that are missing; 3 where
monitoring finds that the model should be trained again.
"""

from __future__ import annotations

import argparse
import sys

from .operators import learning as L
from .operators import training as M
from .operators.contract import ContractError
from .operators.point_in_time import history
from .operators.quality_checks import baseline, gate, report
from .plans.build import build, summary
from .session import session
from .sources import store
from .sources.files import current, read_raw
from .sources.scratch import kept


def _check(spark, args: argparse.Namespace) -> int:
    raw, sums = read_raw(spark, args.folder)
    found = report(raw, sums)
    if args.output:
        store.write_json(spark, found, args.output)
    print(found["summary"])
    code = int(args.fail_on_critical and found["summary"]["critical_failures"] > 0)
    if args.baseline and args.update_baseline:
        store.write_json(spark, baseline(found), args.baseline)
    elif args.baseline:
        worse = gate(found, store.read_json(spark, args.baseline), args.tolerance)
        print("\n".join(worse) or "no regressions")
        code = code or int(bool(worse))
    return code


def _train(spark, args: argparse.Namespace) -> int:
    """Trains on the current run's curated tables and saves the chosen model."""
    tables = current(spark, args.root)
    rows = L.training_rows(tables["curated.shipments"], tables["curated.ports"], history(tables["curated.shipments"], tables["curated.port_events"]))
    model = M.train(kept(rows), permutations=args.permutations, rounds=args.rounds)
    M.save(model, args.model, args.version)
    if args.card:
        store.write_text(spark, args.card, M.model_card(model.metadata | {"version": args.version}))
    print(f"{model.name}: {model.metadata['reason']}")
    return 0


def _monitor(spark, args: argparse.Namespace) -> int:
    tables = current(spark, args.root)
    found = M.monitor(M.load(spark, args.model), tables["curated.shipments"], tables["curated.ports"], args.date_from, args.date_to, args.last_days)
    if args.output:
        store.write_json(spark, found, args.output)
    print("\n".join(found["reasons"]) or "no drift that matters")
    return 3 if found["retrain"] else 0


def main(args: list[str]) -> int:
    parser = argparse.ArgumentParser(prog="quayline", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("build")
    one.add_argument("folder")
    one.add_argument("root")
    two = commands.add_parser("check")
    two.add_argument("folder")
    two.add_argument("--output")
    two.add_argument("--fail-on-critical", action="store_true")
    two.add_argument("--baseline")
    two.add_argument("--tolerance", type=float, default=10.0)
    two.add_argument("--update-baseline", action="store_true")
    three = commands.add_parser("train")
    three.add_argument("root")
    three.add_argument("model")
    three.add_argument("--version", default="1")
    three.add_argument("--permutations", type=int, default=M.PERMUTATIONS)
    three.add_argument("--rounds", type=int, default=1000)
    three.add_argument("--card")
    four = commands.add_parser("monitor")
    four.add_argument("root")
    four.add_argument("model")
    four.add_argument("--from", dest="date_from")
    four.add_argument("--to", dest="date_to")
    four.add_argument("--last-days", type=int)
    four.add_argument("--output")
    chosen, spark = parser.parse_args(args), session()
    try:
        if chosen.command == "train":
            return _train(spark, chosen)
        if chosen.command == "monitor":
            return _monitor(spark, chosen)
        if chosen.command == "build":
            print(summary(build(spark, chosen.folder, chosen.root)))
            return 0
        return _check(spark, chosen)
    except ContractError as error:
        print(error, file=sys.stderr)
        return 1
    except (FileNotFoundError, M.ModelError, ValueError) as error:
        print(error, file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
