"""The command line: ``python -m tidelog FOLDER [--config FILE] [--master URL]`` reads commands from standard input."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from tidelog.config import Config, parse
from tidelog.engine import Shell, Store
from tidelog.session import session


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tidelog", description="A versioned key-value store over Spark.")
    parser.add_argument("folder", help="where the store keeps its runs, log and sketches; all executors must share it")
    parser.add_argument("--config", help="a JSON file of settings")
    parser.add_argument("--master", help="the Spark master, such as local[4]")
    given = parser.parse_args(arguments)
    config = parse(Path(given.config).read_text()) if given.config else Config()
    store = Store(session("tidelog", given.master), given.folder, config)
    for answer in Shell(store).run(line.rstrip("\r\n") for line in sys.stdin):
        print(answer, flush=True)


if __name__ == "__main__":
    main()
