"""``python -m funnelworks run --pipeline NAME --data DIR``, ``... list``."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from .plans.defaults import CATALOG, PARAMETERS, merged
from .plans.pipeline import run
from .plans.registry import DEFAULT, register_pipelines
from .session import build_session, configure_logging
from .sources.catalog import Catalog


def _read(path: Path) -> dict:
    if path.suffix == ".json":
        return json.loads(path.read_text())
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError(f"PyYAML is needed to read {path}") from e
    return yaml.safe_load(path.read_text()) or {}


def _environment(folder: str | None, name: str) -> dict:
    """Of a configuration folder: ``name``.json and .yml, ``name``_*, and the files in ``name``/, each over those before by name."""
    found: dict = {}
    for path in sorted(Path(folder).rglob("*")) if folder else []:
        first = path.relative_to(folder).parts[0]
        if path.suffix in (".json", ".yml", ".yaml") and (first == name or first.startswith((f"{name}.", f"{name}_"))):
            found = merged(found, _read(path))
    return found


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="funnelworks")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="names of pipelines and datasets")
    runs = commands.add_parser("run", help="run a pipeline")
    runs.add_argument("--pipeline", default=DEFAULT)
    runs.add_argument("--data", default="data", help="root of relative dataset paths")
    runs.add_argument("--env", action="append", default=[], help="folder with catalog, parameters and spark settings, as JSON or YAML; later ones win")
    runs.add_argument("--conf", action="append", default=[], metavar="KEY=VALUE", help="Spark setting")
    runs.add_argument("--params", action="append", default=[], metavar="STEP.KEY=VALUE", help="parameter")
    runs.add_argument("--threads", type=int, default=1)
    runs.add_argument("--log-file")
    args = parser.parse_args(argv)
    pipelines = register_pipelines()
    if args.command == "list":
        print("\n".join(["pipelines:", *(f"  {x}" for x in pipelines), "datasets:", *(f"  {x}" for x in CATALOG)]))
        return 0
    if args.pipeline not in pipelines:
        parser.error(f"no pipeline {args.pipeline!r}; there are {', '.join(pipelines)}")
    configure_logging(file=args.log_file)
    given: dict = {}
    for x in args.params:
        path, _, value = x.partition("=")
        step, _, key = path.partition(".")
        given.setdefault(step, {})[key] = json.loads(value) if value[:1] in "[{0123456789\"" and not value[4:5] == "-" else value
    spark_conf = merged({}, *(_environment(e, "spark") for e in args.env), dict(x.split("=", 1) for x in args.conf))
    catalog = merged(CATALOG, *(_environment(e, "catalog") for e in args.env))
    parameters = merged(PARAMETERS, *(_environment(e, "parameters") for e in args.env), given)
    spark = build_session(spark_conf)
    run(pipelines[args.pipeline], Catalog(spark, catalog, root=args.data), parameters, args.threads)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
