"""Shapes of the rows that operators pass on. Lines count from 1, columns and ranges from 0 in code points; a span's end is inclusive, a range's exclusive."""

from __future__ import annotations

POS = "struct<line:int,col:int>"
SPAN = f"struct<start:{POS},end:{POS}>"
RANGE = "struct<start:int,end:int>"
VARIANT = "struct<tag:string,doc_prefix:string,hashes:int>"
ORIGINS = "origin_id string, kind string, path string, content string"
LITERALS = f"origin_id string, lit_idx int, category string, variant {VARIANT}, rendered string, pre int, post int, text string, span {SPAN}"
CHUNKS = f"origin_id string, chunk_idx int, category string, variant {VARIANT}, text string, source_mapping array<struct<range:{RANGE},span:{SPAN}>>"
PLAIN = f"origin_id string, chunk_idx int, plain string, plain_map array<struct<p:{RANGE},r:{RANGE},alias:string>>"
FINDINGS = f"origin_id string, chunk_idx int, detector string, span {SPAN}, range {RANGE}, word string, replacements array<string>, description string"

#: Detectors in the order in which they run; ties between findings at one place go to the first.
DETECTORS = ("hunspell", "zspell", "spellbook", "nlprules", "reflow", "dummy")
