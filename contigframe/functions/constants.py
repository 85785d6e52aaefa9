"""Lookup tables the operators take as defaults."""

from __future__ import annotations

# ---- Fixed values: codons and their ids in the reduced alphabets -------------------------
# The codon order is second base, first base, third base, each in the order T C A G.
CODONS = [first + second + third for second in "TCAG" for first in "TCAG" for third in "TCAG"]

AMINO_ACIDS = "FFLLLLLLIIIMVVVVSSSSPPPPTTTTAAAAYY**HHQQNNKKDDEECC*WRRRRSSRRGGGG"

# Amino acid ids are numbered by first appearance in the codon order; a stop is 0.
AMINO_ACID_IDS = {
    "*": 0, "F": 1, "L": 2, "I": 3, "M": 4, "V": 5, "S": 6, "P": 7, "T": 8, "A": 9, "Y": 10,
    "H": 11, "Q": 12, "N": 13, "K": 14, "D": 15, "E": 16, "C": 17, "W": 18, "R": 19, "G": 20,
}

# Amino acids sharing a group, one string per group; group ids start at 1 and a stop is 0.
PC2_GROUPS = ["IVLFYWGACSTMP", "HKRDEQN"]
PC5_GROUPS = ["FYWH", "IVL", "TMQNP", "GACS", "KRDE"]
MURPHY10_GROUPS = ["FYW", "LVIM", "ST", "P", "A", "H", "EDNQ", "KR", "C", "G"]

# Rank of a codon among the codons of its amino acid.
SYNONYM_RANK = [
    1, 2, 1, 2, 3, 4, 5, 6, 1, 2, 3, 1, 1, 2, 3, 4,
    1, 2, 3, 4, 1, 2, 3, 4, 1, 2, 3, 4, 1, 2, 3, 4,
    1, 2, 1, 2, 1, 2, 1, 2, 1, 2, 1, 2, 1, 2, 1, 2,
    1, 2, 1, 2, 1, 2, 3, 4, 5, 6, 5, 6, 1, 2, 3, 4,
]

# Bases: integer tokens, and positions in a one-hot cell.
BASE_TOKENS = {"A": 1, "G": 2, "T": 3, "C": 4, "N": 0}
BASE_CELLS = {"A": 0, "G": 1, "T": 2, "C": 3}
STRONG_WEAK = {"A": 0, "T": 0, "G": 1, "C": 1}

# IUPAC letters and their complements; both cases map to upper case for a, c, g, t only.
IUPAC_FROM = "ACGTacgtRYKMBVDHWSN-"
IUPAC_TO = "TGCATGCAYRMKVBHDWSN-"

# Classes, their usual order in a score array, and the pairs that may be merged.
CLASSES = ["bacteria", "phage", "eukarya", "archaea", "plasmid", "virus"]
MERGED_PAIRS = {"bacteria_or_plasmid": ("bacteria", "plasmid"), "virus_any": ("phage", "virus")}
VIRAL_NAMES = ("virus", "phage")

# Cost of changing class between neighbouring windows; pairs not named here cost 1.
CHEAP_SWITCH = 0.5
CHEAP_PAIRS = [
    ("bacteria", "phage"), ("bacteria", "plasmid"), ("archaea", "phage"),
    ("archaea", "plasmid"), ("phage", "plasmid"), ("eukarya", "virus"),
]
DEAR_SWITCH = 3.0
DEAR_PAIRS = [
    ("bacteria", "eukarya"), ("archaea", "eukarya"), ("bacteria", "archaea"),
    ("eukarya", "phage"), ("eukarya", "plasmid"),
]

# Short prefixes of taxonomic ranks in a lineage string.
RANK_PREFIX = {
    "superkingdom": "d", "kingdom": "k", "subkingdom": "sk", "superphylum": "sp", "phylum": "p",
    "subphylum": "sph", "superclass": "sc", "class": "c", "subclass": "ssc", "infraclass": "ic",
    "superorder": "so", "order": "o", "suborder": "sor", "infraorder": "io", "parvorder": "po",
    "superfamily": "sf", "family": "f", "subfamily": "sfa", "tribe": "t", "subtribe": "st",
    "genus": "g", "subgenus": "sg", "species group": "sg", "species subgroup": "ssg",
    "species": "s", "subspecies": "ss", "forma": "fo", "varietas": "v", "biotype": "b",
    "realm": "r", "subrealm": "sr",
}
# ---- end of fixed values ------------------------------------------------------------------


def _group_ids(groups: list[str]) -> list[int]:
    of = {aa: n for n, members in enumerate(groups, 1) for aa in members}
    return [of.get(aa, 0) for aa in AMINO_ACIDS]


def alphabet_ids(name: str) -> list[int]:
    """Ids of the 64 codons, in codon order, under a reduced alphabet."""
    if name == "codon_id":
        return list(range(64))
    if name == "aa_id":
        return [AMINO_ACID_IDS[aa] for aa in AMINO_ACIDS]
    if name == "pc2_id":
        return _group_ids(PC2_GROUPS)
    if name == "pc5_id":
        return _group_ids(PC5_GROUPS)
    if name == "murphy10_id":
        return _group_ids(MURPHY10_GROUPS)
    if name == "synonym_rank":
        return list(SYNONYM_RANK)
    raise ValueError(f"unknown codon alphabet: {name}")
