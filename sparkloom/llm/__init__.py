"""Operators for preparing training data: mixing, url filters, fingerprints,
license scans, decontamination, near-dedup, quality, chat formatting, line
dedup and token output.

Nothing outside this subpackage imports it.  ``queries`` lists the driver's
queries, ``oracles`` the SQL that checks them.
"""
