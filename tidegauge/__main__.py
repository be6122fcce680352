"""python -m tidegauge --version; --settings [PATH]: the settings in use; --show QUERY DIR: a registered query's first rows as text."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import asdict

from tidegauge import __version__
from tidegauge.sources.settings import Settings, default_path


def main(argv: list[str] | None = None) -> int:
    """0, or 1 after an error on stderr. Settings that can't be read are a warning there, and the defaults."""
    parser = argparse.ArgumentParser(prog="tidegauge")
    parser.add_argument("--version", action="version", version=__version__)
    parser.add_argument("--settings", nargs="?", const=str(default_path()), metavar="PATH")
    parser.add_argument("--show", nargs=2, metavar=("QUERY", "DIR"))
    args = parser.parse_args(argv)
    if args.settings:
        try:
            with open(args.settings) as f:
                json.load(f)
        except (OSError, ValueError) as e:
            print(f"warning: settings not read, defaults in use: {e}", file=sys.stderr)
        print(json.dumps(asdict(Settings.load(args.settings)), indent=2))
    if args.show:
        from tidegauge.plans import render, scan_catalogue
        from tidegauge.session import session

        name, folder = args.show
        if name not in scan_catalogue.QUERIES:
            print(f"error: no query is called {name}", file=sys.stderr)
            return 1
        print(render.text_table(scan_catalogue.QUERIES[name](session(), folder)))
    return 0


if __name__ == "__main__":
    sys.exit(main())
