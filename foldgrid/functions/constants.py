"""Lookup tables that results depend on."""

from __future__ import annotations

# The 20 standard residues, one letter and three letters.
RESIDUES = {
    "A": "ALA", "R": "ARG", "N": "ASN", "D": "ASP", "C": "CYS", "Q": "GLN", "E": "GLU", "G": "GLY", "H": "HIS", "I": "ILE",
    "L": "LEU", "K": "LYS", "M": "MET", "F": "PHE", "P": "PRO", "S": "SER", "T": "THR", "W": "TRP", "Y": "TYR", "V": "VAL",
}

# Modified residues and the standard residue that each counts as.
MODIFIED = {
    "MSE": "MET", "FME": "MET", "CXM": "MET",
    "M3L": "LYS", "MLY": "LYS", "MLZ": "LYS", "KCX": "LYS", "ALY": "LYS", "LLP": "LYS",
    "CSO": "CYS", "CME": "CYS", "OCS": "CYS", "SEC": "CYS", "SMC": "CYS", "CSD": "CYS",
    "SEP": "SER", "TPO": "THR", "PTR": "TYR", "TYS": "TYR", "HYP": "PRO", "BHD": "ASP", "CGU": "GLU", "PCA": "GLN",
    "NEP": "HIS", "HIC": "HIS",
}

# Hydrophobicity relative to glycine.
HYDROPHOBICITY = {
    "F": 100, "I": 99, "W": 97, "L": 97, "V": 76, "M": 74, "Y": 63, "C": 49, "A": 41, "T": 13,
    "H": 8, "G": 0, "S": -5, "Q": -20, "R": -14, "K": -23, "N": -28, "E": -31, "P": -46, "D": -55,
}

# Residues that count as hydrophilic (1); the other standard ones count as hydrophobic (0).
HYDROPHILIC = "RNDQEHKSTY"

# Charged residues; all others are neutral, for which the value 100 stands.
POSITIVE, NEGATIVE, NEUTRAL = "RHK", "DE", 100

# Residue names of water and of ions.
SOLVENT_NAMES = ("HOH", "WAT", "TIP3", "TIP4", "SPC", "T3P", "T4P", "T5P")
ION_NAMES = ("NA", "CL", "K", "MG", "CA", "ZN", "NA+", "CL-", "K+", "MG2+", "CA2+", "ZN2+")
STRIPPED_NAMES = ("HOH", "WAT", "TIP3", "SOL", "NA", "CL", "K", "MG", "ZN")

UNKNOWN_RESIDUE = "UNK"

# Coulomb constant in kJ nm / (mol e^2), shortest distance and Lennard-Jones cutoff in nm.
COULOMB = 138.935456
CLOSEST, LJ_CUTOFF = 0.1, 0.8
