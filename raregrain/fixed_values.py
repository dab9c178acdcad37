"""Values that existing models and files depend on; they must not be changed."""

# Token order of the trained feature layout. Position i of every
# count vector belongs to token i of this list.
TOKEN_ORDER = [
    "C", "#", "@", "H", "=", "O", "N", "c", "-", ".", "l", "B",
    "r", "n", "D", "y", "o", "s", "S", "F", "+", "i", "/", "I",
]

# Codes of the three target names.
CATEGORY_CODES = {"BRD4": 1, "HSA": 2, "sEH": 3}

# Column renames applied to the raw table before descriptors.
RAW_RENAMES = {
    "buildingblock1_smiles": "bb1_smiles",
    "buildingblock2_smiles": "bb2_smiles",
    "buildingblock3_smiles": "bb3_smiles",
}

# Column prefixes of the wide layout, per count array.
WIDE_PREFIXES = {"bb1": "a", "bb2": "b", "bb3": "c", "molecule": "d"}

# Upper bounds of the four-rule screen.
RULE_BOUNDS = {"MW": 500.0, "LogP": 5.0, "NumHDonors": 5.0, "NumHAcceptors": 10.0}

# Fixed value: label given to rows that have none.
UNLABELLED = 2
