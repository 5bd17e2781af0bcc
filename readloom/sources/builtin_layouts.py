"""Layouts of common kits."""

from __future__ import annotations

import os

from readloom.sources.layouts import Element, from_csv, from_seqspec

_HEADER = "id,seq,expected_length,type,class,whitelist,flags\n"

# Adapters, lengths and lists of the kits.
_LAYOUTS = {
    "five_prime": """\
forw_primer,CTACACGACGCTCTTCCGATCT,,static,,,
barcode,,16,variable,barcode,10x_5v1,
umi,,10,variable,umi,,
tso,TTTCTTATATGGG,,static,tso,,
read,,,variable,read,,
poly_a,,,static,poly_a,,
rev_primer,GTACTCTGCGTTGATACCACTGCTT,,static,,,
""",
    "nanopore_bulk_rapid_bc": """\
linker_1,AATGTACTTCGTTCAGTTACGTATTGCTAAGGTTAANNNNNNNNNNNNNNNNNNNNNNNNCAGCACCT,,static,,,
read,,,variable,read,,
linker_3,AGGTGCTGNNNNNNNNNNNNNNNNNNNNNNNNTTAACCTTAGCAATACGTAACTGAACGAAGT,,static,,,
""",
    "sctagger_sim": """\
forw_primer,CTACACGACGCTCTTCCGATCT,,static,,,
barcode,,16,variable,barcode,10x_3v3,
umi,,10,variable,umi,,
poly_a,,,static,poly_a,,
read,,,variable,read,,
""",
    "splitseq": """\
read,,,variable,read,,
barcode_1,,8,variable,barcode,splitseq_bc2,
linker_1,CCACAGTCTCAAGCACGTGGAT,,static,linker,,
barcode_2,,8,variable,barcode,splitseq_bc1,
linker_2,AGTCGTACGCCGATGCGAAACATCGGCCAC,,static,linker,,
barcode_3,,8,variable,barcode,splitseq_bc1,
umi,,10,variable,umi,,
""",
    "three_prime": """\
forw_primer,CTACACGACGCTCTTCCGATCT,,static,,,
barcode,,16,variable,barcode,10x_3v3,
umi,,12,variable,umi,,
poly_t,,,static,poly_t,,
read,,,variable,read,,
rev_primer,ACTCTGCGTTGATACCACTGCTT,,static,,,
""",
    "visium_hd": """\
forw_primer,CTACACGACGCTCTTCCGATCT,,static,,,
umi,,9,variable,umi,,
barcode_1,,15-16,variable,barcode,visium_hd_bc1,joint_barcode
barcode_2,,14-15,variable,barcode,visium_hd_bc2,joint_barcode
poly_t,,,static,poly_t,,
read,,,variable,read,,
rev_primer,ACTCTGCGTTGATACCACTGCTT,,static,,,
""",
    "visium_three_prime": """\
forw_primer,CTACACGACGCTCTTCCGATCT,,static,,,
barcode,,16,variable,barcode,10x_Vis_V1,
umi,,12,variable,umi,,
poly_t,,,static,poly_t,,
read,,,variable,read,,
rev_primer,ACTCTGCGTTGATACCACTGCTT,,static,,,
""",
}


def keys() -> list[str]:
    return list(_LAYOUTS)


def load(reference: str, whitelist: str | None = None) -> list[Element]:
    """Layout of a built-in key, a CSV file or a seqspec YAML file."""
    if reference in _LAYOUTS:
        return from_csv(_HEADER + _LAYOUTS[reference])
    if not os.path.isfile(reference):
        raise ValueError(f"neither a layout file nor a key: {reference}")
    with open(reference, encoding="utf-8") as f:
        text = f.read()
    return from_seqspec(text, whitelist) if reference.lower().endswith((".yaml", ".yml")) else from_csv(text)
