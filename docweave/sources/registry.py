"""Readers by suffix.  Plain text and Markdown have a reader but no suffix of their own unless asked for."""

from __future__ import annotations

from collections.abc import Callable

from docweave.sources import html, hwp5, hwpx, layout
from docweave.sources.evidence import Parsed, Reader


def _no_pages(data: bytes) -> Parsed:
    found = Parsed()
    if data:
        found.warn("pdf_page_source_missing", "high", message="no library that yields the pages of a PDF was given")
    return found


def default_readers(pdf_pages: Callable[[bytes], list[dict]] | None = None, ocr: layout.Ocr | None = None) -> dict[str, Reader]:
    """pdf_pages yields what ``sources.layout`` reads of each page of a PDF; without it PDFs have a warning and no units."""
    pdf = layout.parse_with(pdf_pages, ocr) if pdf_pages else _no_pages
    return {".pdf": pdf, ".htm": html.parse, ".html": html.parse, ".hwpx": hwpx.parse, ".hwp": hwp5.parse, ".pages.json": layout.parse_json}
