"""termloom validate LEXICON | try LEXICON --locale TAG PROMPT | schema

Exit codes: 0 all well, 1 the lexicon is invalid, 2 wrong usage, 3 the lexicon can't be read or isn't JSON, 4 no match,
5 the prompt was rejected.
"""

from __future__ import annotations

import argparse
import json
import sys

from termloom.plans.resolver import EntityResolver
from termloom.sources.lexicon import Lexicon, MalformedDocumentError, ValidationError, json_schema
from termloom.sources.outcomes import faults_text, malformed_text, report_text, unreadable_text, valid_text

OK, INVALID, UNREADABLE, NO_MATCH, REJECTED = 0, 1, 3, 4, 5


def load(source: str) -> Lexicon | int:
    """The lexicon, or the exit code of what went wrong, which has been said then."""
    try:
        return Lexicon.from_file(source)
    except OSError as e:
        said, code = unreadable_text(source, e), UNREADABLE
    except MalformedDocumentError as e:
        said, code = malformed_text(e), UNREADABLE
    except ValidationError as e:
        said, code = faults_text(source, [e]), INVALID
    print(said, file=sys.stderr)
    return code


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="termloom", description="Check lexicons and try prompts.")
    commands = parser.add_subparsers(dest="command", required=True)
    validate = commands.add_parser("validate", help="check a lexicon file")
    validate.add_argument("lexicon")
    attempt = commands.add_parser("try", help="resolve a prompt and print its report")
    attempt.add_argument("lexicon")
    attempt.add_argument("--locale", required=True)
    attempt.add_argument("prompt")
    commands.add_parser("schema", help="print the format as a JSON Schema")
    args = parser.parse_args(argv)
    if args.command == "schema":
        print(json.dumps(json_schema(), indent=2))
        return OK
    lexicon = load(args.lexicon)
    if isinstance(lexicon, int):
        return lexicon
    if args.command == "validate":
        print(valid_text(args.lexicon))
        return OK
    try:
        report = EntityResolver(lexicon).report_of(args.prompt, args.locale)
    except ValidationError as e:
        print(f"termloom: {e.message}", file=sys.stderr)
        return REJECTED
    print(report_text(report))
    return OK if report["matches"] else NO_MATCH
