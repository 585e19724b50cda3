"""Command: a JSON report as a short markdown text."""

from __future__ import annotations

import argparse

from tideline.session import build_session
from tideline.sources.sinks import summarize_file


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description="Summarise a pivot report")
    p.add_argument("--report", required=True)
    p.add_argument("--out", required=True)
    a = p.parse_args(args)
    summarize_file(build_session("summarize"), a.report, a.out)


if __name__ == "__main__":
    main()
