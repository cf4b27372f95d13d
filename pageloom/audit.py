"""``python -m pageloom.audit``: does a schema run? Exit 0: all supported; 1: something isn't; 2: nothing could be audited."""

from __future__ import annotations

import argparse
import importlib
import importlib.util
import json
import sys
from pathlib import Path
from typing import Any

from pageloom.page import Page
from pageloom.plans.verdict import SchemaReport
from pageloom.scan import Site, scan_source
from pageloom.spec import PageObject


def _loaded(module: str) -> Any:
    """A module by its name, or by the path of its file."""
    if not module.endswith(".py"):
        return importlib.import_module(module)
    path = Path(module)
    spec = importlib.util.spec_from_file_location(f"audited_{path.stem}", path)
    if spec is None or spec.loader is None or not path.exists():
        raise ImportError(f"no file {module!r}")
    loaded = importlib.util.module_from_spec(spec)
    sys.modules[spec.name] = loaded  # dataclasses and the like look their module up
    spec.loader.exec_module(loaded)
    return loaded


def schemas(target: str) -> dict[str, SchemaReport]:
    """Reports of the Page objects and page classes of ``module`` (or of a file; names with an underscore and second names of one object are left out), or of those in ``module:NAME`` (one of them, or a list or mapping)."""
    module, _, name = target.rpartition(":") if ".py:" in target else (target, "", "") if target.endswith(".py") else target.partition(":")
    loaded = _loaded(module)
    found: dict[str, Any] = {}
    if name:
        held = getattr(loaded, name)
        found = dict(held) if isinstance(held, dict) else {f"{name}[{i}]": x for i, x in enumerate(held)} if isinstance(held, (list, tuple)) else {name: held}
    else:
        seen: set[int] = set()
        found = {k: v for k, v in vars(loaded).items() if not k.startswith("_") and id(v) not in seen and not seen.add(id(v)) and (isinstance(v, Page) or (isinstance(v, type) and issubclass(v, PageObject) and v is not PageObject and v.__module__ == loaded.__name__))}
    return {k: v.check() for k, v in found.items()}


def sites(paths: list[str]) -> list[Site]:
    files = [f for p in paths for f in (sorted(Path(p).rglob("*.py")) if Path(p).is_dir() else [Path(p)])]
    return [s for f in files for s in scan_source(f.read_text(encoding="utf-8", errors="replace"), str(f))]


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="pageloom.audit", description=__doc__)
    parser.add_argument("targets", nargs="+", help="module or module:NAME; with --scan files and folders")
    parser.add_argument("--scan", action="store_true", help="read Python source without importing it")
    parser.add_argument("--json", action="store_true")
    parser.add_argument("-v", "--verbose", action="store_true", help="list what is supported too")
    args = parser.parse_args(argv)
    rows: list[dict] = []
    failed = False
    try:
        if args.scan:
            for s in sites(args.targets):
                supported, reason = s.verdict()
                rows.append({"where": f"{s.path}:{s.line}", "call": s.call, "selector": s.selector, "supported": supported, "reason": reason})
                failed |= s.call == "<syntax-error>"
        else:
            for target in args.targets:
                for name, report in schemas(target).items():
                    for group, field, selector, supported, reason in report.rows():
                        rows.append({"where": f"{target}.{name}" + (f".{group}" if group else ""), "call": field, "selector": selector, "supported": supported, "reason": reason})
                    if report.over_budget:
                        rows.append({"where": f"{target}.{name}", "call": "<budget>", "selector": None, "supported": False, "reason": f"{report.members} selectors"})
    except (ImportError, AttributeError, OSError) as error:
        print(error, file=sys.stderr)
        return 2
    if args.json:
        print(json.dumps(rows, ensure_ascii=False))
    else:
        for r in rows:
            if args.verbose or r["supported"] is False:
                print("ok  " if r["supported"] else "skip" if r["supported"] is None else "no  ", r["where"], r["call"], r["selector"] or "", r["reason"] or "")
        print(f"{sum(r['supported'] is True for r in rows)} supported, {sum(r['supported'] is False for r in rows)} not, {sum(r['supported'] is None for r in rows)} skipped")
    return 2 if not rows or failed else int(any(r["supported"] is False for r in rows))


if __name__ == "__main__":
    sys.exit(main())
