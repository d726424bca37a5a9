"""Readers and writers: delimited text, lab sheets, bundles, sequencing reads."""
