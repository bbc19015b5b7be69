"""Canonical forms of legal suffixes and address words.

A word that isn't listed stands for itself, so only abbreviations are listed.
"""

from __future__ import annotations


def _pairs(text: str) -> dict[str, str]:
    return dict(line.split() for line in text.strip().splitlines())


# Abbreviations of legal suffixes.
LEGAL = _pairs("""
pvt private
ltd limited
corp corporation
inc incorporated
co company
""")
# Canonical suffixes, which a core name leaves out.
LEGAL_SUFFIXES = ("private", "limited", "corporation", "incorporated", "company", "llc", "llp", "plc", "lp")

# Abbreviations in addresses, the short table.
ADDRESS_SHORT = _pairs("""
rd road
st street
ave avenue
av avenue
dr drive
ln lane
blvd boulevard
hwy highway
pkwy parkway
ct court
cir circle
pl place
""")
# What the long table adds.
ADDRESS_LONG = ADDRESS_SHORT | _pairs("""
ter terrace
trl trail
apt apartment
appt apartment
fl floor
rm room
ste suite
bldg building
no number
num number
""")
