"""Readers and writers: CSV, libsvm, text, delimited samples, file trees, sinks."""

from kilowatt.sources.csv import scan_csv, write_csv
from kilowatt.sources.delimited import scan_baskets, scan_delimited, scan_labeled_rows, scan_number_rows
from kilowatt.sources.files import scan_files
from kilowatt.sources.libsvm import scan_libsvm, write_libsvm
from kilowatt.sources.sinks import preview, read_pairs_text, schema_table, timed, write_pairs_text
from kilowatt.sources.text import scan_text

__all__ = [
    "scan_csv",
    "write_csv",
    "scan_delimited",
    "scan_number_rows",
    "scan_labeled_rows",
    "scan_baskets",
    "scan_files",
    "scan_libsvm",
    "write_libsvm",
    "scan_text",
    "write_pairs_text",
    "read_pairs_text",
    "preview",
    "schema_table",
    "timed",
]
