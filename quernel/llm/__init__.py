"""Training-data operators: near-duplicate search, scans, extraction, mixing, packing and selection.

Nothing outside this subpackage imports it; deleting the folder leaves the rest of the library whole.
"""
