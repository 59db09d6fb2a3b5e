"""Commands: query, sources, import, audit, splits, rule, simulate, search, control."""

from __future__ import annotations

import argparse
import json
import sys
import tomllib
from pathlib import Path

from .rules import RuleError, compile_rule


def _spark():
    from .session import get_session

    return get_session()


def load_config(path: str) -> dict:
    """A configuration in TOML or JSON, by the file's name."""
    text = Path(path).read_text()
    return tomllib.loads(text) if path.endswith(".toml") else json.loads(text)


def _registry(path: str):
    from .sources.integrity import Asset, Source

    return [Source(s["id"], [Asset(**a) for a in s["assets"]], s.get("license", {}), s.get("milestones", [])) for s in load_config(path)["sources"]]


def query(a) -> int:
    from .plans import catalogue

    queries, _ = catalogue.collect()
    if a.list:
        print("\n".join(sorted(queries)))
        return 0
    df = queries[a.name](_spark(), a.tables)
    if a.out:
        from .sources.integrity import write_once

        write_once(df, a.out)
    else:
        df.show(a.rows, truncate=False)
    return 0


def sources(a) -> int:
    from .sources import integrity

    wanted = [s for s in _registry(a.registry) if not a.ids or s.id in a.ids]
    if a.action == "list":
        for s in wanted:
            print(s.id, len(s.assets), s.license.get("spdx") or s.license.get("status", "unknown"))
        return 0
    if a.action == "fetch":
        out = integrity.fetch(wanted, a.folder, a.jobs)
    else:
        out = {f"{s.id}/{x.path}": integrity.check_file(x, Path(a.folder) / s.id / x.path, a.quick) for s in wanted for x in s.assets}
    for k, v in out.items():
        print(v, k)
    return int(any(v.startswith(("failed", "mismatch", "missing", "differs")) for v in out.values()))


def import_(a) -> int:
    """Recordings into normalised tables, each written once, and a manifest of their rows, nulls and flags as seen while
    writing; exit 1 if a check disagrees and --strict is given."""
    from .importers.recordings import import_recordings
    from .sources.integrity import observed_manifest, write_observed, write_once

    spark, bad, seen = _spark(), 0, {}
    for name, df in import_recordings(spark, a.texts, a.archive).items():
        seen[name] = write_observed(df, f"{a.out}/{name}")
        print(name, seen[name][0]["rows"])
        if name == "checks":
            failed = [r["column"] for r in seen[name] if r["true"] is not None and r["true"] + r["nulls"] < r["rows"]]
            print("disagree:", ", ".join(failed) or "none")
            bad = len(failed)
    write_once(observed_manifest(spark, seen), f"{a.out}/manifest")
    return int(a.strict and bad > 0)


def audit(a) -> int:
    """Lay out an import's windows, write the audit's tables and its report; exit 1 where no target can be held out."""
    import hashlib

    from pyspark.sql import functions as F

    from . import audit as au
    from .sources import layout

    spark = _spark()
    layout.prepare(spark, a.folder, f"{a.out}/laid")
    source = hashlib.sha256("\n".join(sorted(r[0] for r in spark.read.parquet(f"{a.folder}/manifest").select(F.to_json(F.struct("*"))).collect())).encode()).hexdigest()
    t = au.Thresholds(seed=a.seed, draws=a.draws)
    text = au.write(au.audit(spark, a.folder, f"{a.out}/laid", t), a.out, source, t)
    Path(a.report).write_text(text)
    go = spark.read.parquet(f"{a.out}/facts").filter("section = 'go'").first()["value"]
    print("go" if go else "no-go", int(go))
    return int(not go)


def control(a) -> int:
    """The verdict on a rule, from a table of held-out scores per animal and one of coverage per level (CSV)."""
    import pandas as pd

    from .search.controls import Resampling, verdict

    print(json.dumps(verdict(pd.read_csv(a.scores), pd.read_csv(a.coverage), Resampling(a.draws, a.seed)), default=bool, indent=1))
    return 0


def split(a) -> int:
    from .operators import splits
    from .sources.integrity import write_locked

    rows = _spark().read.parquet(a.table)
    folds = splits.nested(rows, a.group, a.k, a.inner, a.seed)
    splits.check(folds, a.group)
    data = [r.asDict() for r in folds.orderBy("outer", "role", "inner", a.group).collect()]  # one row per group and fold
    print(write_locked(a.out, {"seed": a.seed, "k": a.k, "inner": a.inner, "folds": data}))
    return 0


def rule(a) -> int:
    p = compile_rule(Path(a.file).read_text())
    print(json.dumps(p.to_json(), indent=1) if a.action == "inspect" else p.text, end="")
    return 0


def simulate(a) -> int:
    from .rules.program import from_json
    from .sim.arrays import simulate as run

    text = Path(a.program).read_text()
    p = from_json(json.loads(text)) if a.program.endswith(".json") else compile_rule(text)
    spec = json.loads(Path(a.case).read_text())
    r = run(p, spec.get("input", spec))
    print(json.dumps({"program_hash": p.hash, "sample_ticks": r.ticks, "neurons": r.neurons, "registers": {k: v.tolist() for k, v in r.registers.items()}, "observation": r.observation.tolist()}))
    return 0


def search(a) -> int:
    from .search import enumerate as en

    found = en.enumerate_programs(_spark(), load_config(a.config))
    found = found.persist()
    if a.out:
        found.filter("outcome = 'ok'").select("index", "hash", "l_struct", "l_params", "source").write.json(a.out)
    print(json.dumps(en.summary(found)))
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="trialforge", description=__doc__)
    sub = parser.add_subparsers(required=True)
    q = sub.add_parser("query")
    q.add_argument("name", nargs="?")
    q.add_argument("--list", action="store_true")
    q.add_argument("--tables", default=".")
    q.add_argument("--out")
    q.add_argument("--rows", type=int, default=20)
    q.set_defaults(run=query)
    s = sub.add_parser("sources")
    s.add_argument("action", choices=("list", "fetch", "verify"))
    s.add_argument("registry")
    s.add_argument("--ids", nargs="*")
    s.add_argument("--folder", default="data")
    s.add_argument("--jobs", type=int, default=4)
    s.add_argument("--quick", action="store_true")
    s.set_defaults(run=sources)
    i = sub.add_parser("import")
    for name in ("texts", "archive", "out"):
        i.add_argument(name)
    i.add_argument("--strict", action="store_true")
    i.set_defaults(run=import_)
    u = sub.add_parser("audit")
    for name in ("folder", "out", "report"):
        u.add_argument(name)
    for name, default in (("draws", 2000), ("seed", 20261008)):
        u.add_argument(f"--{name}", type=int, default=default)
    u.set_defaults(run=audit)
    c = sub.add_parser("control")
    for name in ("scores", "coverage"):
        c.add_argument(name)
    for name, default in (("draws", 2000), ("seed", 20261008)):
        c.add_argument(f"--{name}", type=int, default=default)
    c.set_defaults(run=control)
    p = sub.add_parser("splits")
    for name in ("table", "group", "out"):
        p.add_argument(name)
    for name, default in (("k", 5), ("inner", 4), ("seed", 20261008)):
        p.add_argument(f"--{name}", type=int, default=default)
    p.set_defaults(run=split)
    r = sub.add_parser("rule")
    r.add_argument("action", choices=("inspect", "canon"))
    r.add_argument("file")
    r.set_defaults(run=rule)
    m = sub.add_parser("simulate")
    m.add_argument("--program", required=True)
    m.add_argument("--case", required=True)
    m.set_defaults(run=simulate)
    e = sub.add_parser("search")
    e.add_argument("config")
    e.add_argument("--out")
    e.set_defaults(run=search)
    args = parser.parse_args(argv)
    try:
        return args.run(args)
    except RuleError as err:
        print(f"error: {err}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
