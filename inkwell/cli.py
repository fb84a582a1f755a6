"""Command line: one file, or standard input, to Markdown."""

from __future__ import annotations

import argparse
import codecs
import os
import sys
from pathlib import Path

from inkwell import plugins
from inkwell.parsers.charset import CODECS

VERSION = "0.1.0"


class Usage(ValueError):
    """Wrong arguments."""


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="inkwell", description="Convert various file formats to Markdown")
    p.add_argument("input", nargs="?")
    p.add_argument("-o", "--output", help="write to a file instead of standard output")
    p.add_argument("-x", "--extension", help="extension hint, for standard input")
    p.add_argument("-m", "--mime-type", help="media type hint")
    p.add_argument("-c", "--charset", help="charset hint")
    p.add_argument("-p", "--use-plugins", action="store_true")
    p.add_argument("--list-plugins", action="store_true")
    p.add_argument("-d", "--use-docintel", action="store_true")
    p.add_argument("-e", "--endpoint", help="address of the document service")
    p.add_argument("--use-cu", "--use-content-understanding", action="store_true", dest="use_cu")
    p.add_argument("--cu-endpoint", help="address of the content service")
    p.add_argument("--cu-analyzer-id", "--cu-analyzer", dest="cu_analyzer_id")
    p.add_argument("--cu-file-types", help="comma-separated file types")
    p.add_argument("--keep-data-uris", action="store_true")
    p.add_argument("-v", "--version", action="version", version=VERSION)
    return p


def checked(args: argparse.Namespace) -> argparse.Namespace:
    """Hints made regular; combinations that can't work are refused."""
    for name in ("extension", "mime_type", "charset"):
        value = (getattr(args, name) or "").strip()
        setattr(args, name, value or None)
    if args.extension:
        args.extension = "." + args.extension.lower().removeprefix(".")
    if args.mime_type and len(args.mime_type.split("/")) != 2:
        raise Usage(f"Invalid MIME type: {args.mime_type}")
    if args.charset and args.charset.lower().replace("_", "-") not in CODECS:
        try:
            codecs.lookup(args.charset)
        except LookupError:
            raise Usage(f"Invalid charset: {args.charset}") from None
    if args.endpoint:
        args.use_docintel = True
    elif args.use_docintel:
        args.endpoint = os.environ.get("DOCUMENT_INTELLIGENCE_ENDPOINT")
    if args.use_cu and not args.cu_endpoint:
        args.cu_endpoint = os.environ.get("AZURE_CONTENT_UNDERSTANDING_ENDPOINT")
    if args.endpoint and args.cu_endpoint:
        raise Usage("The document service and the content service cannot be used together.")
    if args.use_docintel and not args.endpoint:
        raise Usage("An endpoint is required for the document service.")
    if args.use_cu and not args.cu_endpoint:
        raise Usage("An endpoint (--cu-endpoint) is required for the content service.")
    if (args.endpoint or args.cu_endpoint) and not args.input:
        raise Usage("A filename is required for the cloud services.")
    if args.cu_file_types:
        from inkwell.cloud import FILE_TYPES

        args.cu_file_types = [t for t in (x.strip().lower() for x in args.cu_file_types.split(",")) if t]
        unknown = [t for t in args.cu_file_types if t not in FILE_TYPES]
        if unknown:
            raise Usage(f"Unknown file type: {unknown[0]}")
    return args


def main(argv: list[str] | None = None, client=None) -> int:
    """client: how to reach the cloud services; without one they can't be used."""
    from inkwell.cloud import FILE_TYPES, auth_headers, content_service, document_service
    from inkwell.api import convert_file
    from inkwell.plans.convert import Options
    from inkwell.providers import Providers

    args = parser().parse_args(argv)
    try:
        if args.list_plugins:
            found, errors = plugins.discover()
            print("\n".join([*(f"  * {n}" for n in found), *errors]) or "No plugins installed.")
            return 0
        args = checked(args)
        registry, errors = plugins.enabled(args.use_plugins)
        for e in errors:
            print(e, file=sys.stderr)
        analyze = None
        if args.endpoint or args.cu_endpoint:
            if client is None:
                raise Usage("No client for the cloud services is configured.")
            types = tuple(args.cu_file_types or FILE_TYPES)
            credential = auth_headers()  # of this process: executors have no part in its environment
            auth = lambda: credential
            analyze = document_service(args.endpoint, client, auth) if args.endpoint else content_service(args.cu_endpoint, client, auth, args.cu_analyzer_id, types=types)
        data = Path(args.input).read_bytes() if args.input else sys.stdin.buffer.read()
        name = Path(args.input).name if args.input else None
        suffix = Path(args.input).suffix.lower() if args.input else None
        info = {"extension": args.extension or suffix or None, "mimetype": args.mime_type, "charset": args.charset, "filename": name, "local_path": args.input}
        out = convert_file(data, info, Options(keep_data_uris=args.keep_data_uris, providers=Providers(analyze=analyze)), registry)
        if out.status != "ok":
            raise RuntimeError(f"{out.status}: " + "; ".join(f"{a.converter}: {a.message}" for a in out.attempts))
        text = out.markdown
        if args.output:
            Path(args.output).write_text(text, encoding="utf-8")
        else:
            sys.stdout.write(text if text.endswith("\n") else text + "\n")
        return 0
    except (Usage, RuntimeError, OSError, ValueError) as e:
        print(f"Error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
