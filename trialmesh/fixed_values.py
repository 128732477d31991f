"""Vocabularies, lookup tables, limits and formats that results depend on.

They are data, not logic. Every operator takes them as arguments, so other domains pass their own.
"""

# Accepted headers per canonical column.
COLUMN_ALIASES = {
    "candidate_id": [
        "candidate_id", "Candidate_ID", "Selection_Order", "Formulation_ID",
        "Sample", "ID", "No", "NO", "no", "编号", "配方编号",
    ],
    "IL1": ["Ionizable_Lipid_1", "IL1", "ionizable lipid 1", "可离子化脂质1", "离子化脂质1"],
    "IL2": ["Ionizable_Lipid_2", "IL2", "ionizable lipid 2", "可离子化脂质2", "离子化脂质2"],
    "IL1_molpct": ["IL1_Mol_Percent", "IL1_molpct", "IL1 mol%", "IL1 mol pct"],
    "IL2_molpct": ["IL2_Mol_Percent", "IL2_molpct", "IL2 mol%", "IL2 mol pct"],
    "Phospholipid": ["Phospholipid", "HL", "Helper_Lipid", "磷脂"],
    "HL_molpct": ["Phospholipid_Mol_Percent", "HL_molpct", "Helper_Lipid_Mol_Percent", "磷脂比例"],
    "CHOL_molpct": ["Cholesterol_Mol_Percent", "CHOL_molpct", "Cholesterol", "胆固醇比例"],
    "PEG": ["PEG类型", "PEG", "PEG_Lipid", "PEG lipid"],
    "PEG_molpct": ["PEG_Mol_Percent", "PEG_molpct", "PEG mol%", "PEG比例"],
    "NP_ratio": ["N/P", "NP_ratio", "N_P_ratio", "N/P ratio"],
    "Round": ["Round", "round", "轮次"],
}
NAME_COLUMNS = ["IL1", "IL2", "Phospholipid", "PEG"]
PERCENT_COLUMNS = ["IL1_molpct", "IL2_molpct", "HL_molpct", "CHOL_molpct", "PEG_molpct"]
RATIO_COLUMN = "NP_ratio"
COMPOSITION_COLUMNS = ["IL1", "IL1_molpct", "IL2", "IL2_molpct", "Phospholipid", "HL_molpct", "CHOL_molpct", "PEG", "PEG_molpct", "NP_ratio"]

# Header keywords of the quality columns.
PDI_KEYWORDS = ["pdi", "polydispers", "多分散"]
SIZE_KEYWORDS = ["particle_size", "z-ave", "zave", "diameter", "size", "粒径"]

# Texts that mean "no component".
MISSING_NAMES = ["", "nan", "none", "na", "-", "无"]

# Component name variants (upper case) and their canonical names.
COMPONENT_ALIASES = {
    "DLIN-MC3-DMA": "MC3", "DLIN-MC3": "MC3", "MC-3": "MC3",
    "SM-102": "SM102", "SM 102": "SM102", "SM102": "SM102",
    "C12200": "C12-200", "C12 200": "C12-200", "C12-200": "C12-200",
    "CKKE12": "CKK-E12", "CKK E12": "CKK-E12", "CCK12": "CKK-E12",
    "CKK-E12": "CKK-E12", "CKK E12 (CCK12)": "CKK-E12",
    "ALC0315": "ALC-0315", "ALC 0315": "ALC-0315", "ALC-0315": "ALC-0315",
    "DMG-PEG": "DMG-PEG2000", "DMG-PEG-2000": "DMG-PEG2000",
    "DMGPEG2000": "DMG-PEG2000", "PEG2000-DMG": "DMG-PEG2000",
    "PEG-DMG": "DMG-PEG2000", "DMG-PEG2000": "DMG-PEG2000",
    "ALC-0159": "C14-PEG", "ALC0159": "C14-PEG", "C14PEG": "C14-PEG",
    "C14-PEG": "C14-PEG",
    "PEG-MANNOSE": "PEG-Mannose", "MANNOSE-PEG": "PEG-Mannose",
    "PEG MANNOSE": "PEG-Mannose", "PEG-Mannose": "PEG-Mannose",
    "CHOL": "Cholesterol", "CHOLESTEROL": "Cholesterol",
    "DSPC": "DSPC", "DOPE": "DOPE", "DOTAP": "DOTAP",
    "DODAP": "DODAP", "MC3": "MC3",
}

# Category lists of the one-hot block.
ACTIVE_CATEGORIES = ["ALC-0315", "C12-200", "CKK-E12", "DODAP", "DOTAP", "MC3", "SM102", "UNKNOWN"]
SECOND_ACTIVE_CATEGORIES = ["NONE"] + ACTIVE_CATEGORIES
HELPER_CATEGORIES = ["DOPE", "DSPC", "UNKNOWN"]
PEG_CATEGORIES = ["C14-PEG", "DMG-PEG2000", "PEG-Mannose", "UNKNOWN"]
KNOWN_COMPONENTS = ["ALC-0315", "C12-200", "CKK-E12", "DODAP", "DOTAP", "MC3", "SM102", "DSPC", "DOPE", "Cholesterol", "DMG-PEG2000", "C14-PEG", "PEG-Mannose"]

# Descriptors of the active components, one line per component.
DESCRIPTOR_NAMES = [
    "head_ionizable_amine", "head_quaternary", "head_polyamine",
    "linker_ester", "linker_amide", "linker_ether", "linker_degradable",
    "tail_count", "tail_carbons", "tail_double_bonds", "tail_branched", "tail_saturated",
    "clogp", "mw", "tpsa",
]
COMPONENT_DESCRIPTORS = {
    "MC3": [1, 0, 0, 1, 0, 0, 1, 2, 36, 4, 1, 0, 13.5, 642, 0],
    "ALC-0315": [1, 0, 0, 1, 0, 0, 1, 2, 32, 0, 1, 1, 14.0, 766, 0],
    "SM102": [1, 0, 0, 1, 0, 0, 1, 2, 30, 0, 1, 1, 13.8, 710, 0],
    "C12-200": [1, 0, 1, 0, 0, 0, 0, 5, 60, 0, 0, 1, 15.0, 1108, 0],
    "CKK-E12": [1, 0, 1, 0, 1, 1, 1, 4, 48, 0, 0, 1, 12.0, 1100, 0],
    "DOTAP": [0, 1, 0, 1, 0, 0, 1, 2, 36, 2, 0, 0, 13.0, 698, 0],
    "DODAP": [1, 0, 0, 1, 0, 0, 1, 2, 36, 2, 0, 0, 13.0, 648, 0],
}

# Row validity and quality limits.
PERCENT_SUM_RANGE = (80.0, 120.0)
PDI_MAX = 0.5
SIZE_RANGE = (30.0, 300.0)

# Feasible region of generated mixtures: (low, high).
TOTAL_ACTIVE_RANGE = (20.0, 67.0)
HELPER_RANGE = (5.0, 50.0)
CHOL_RANGE = (0.0, 58.0)
PEG_RANGE = (1.0, 4.0)
CLOSED_SUM_RANGE = (99.0, 101.0)

# Vector columns such as fp_0, bit-3, morgan 7.
VECTOR_COLUMN_PATTERN = r"^(fp|bit|morgan|ecfp)[_\- ]?(\d+)$"
# Labels that mark an identifier column.
ROUND_LABEL_PATTERN = r"(?i)^R[234]\s*[-_ ]?\s*0*\d+"
INTEGER_TEXT_PATTERN = r"^\d+(\.0+)?$"
ROUND_PATTERN = r"(?i)R\s*(\d+)"

# Order of panel roles in reports.
ROLE_ORDER = ["HighConsensus", "HighDiverse", "Intermediate", "LowControl", "ModelDisagreement", "Fallback"]

# Panel composition: roles, the share of either kind of control, and the sizes of the diverse and the disputed role.
PANEL_ROLES = ["HighConsensus", "HighDiverse", "Intermediate", "LowControl", "ModelDisagreement"]
PANEL_CONTROL_SHARE = 0.17
PANEL_DIVERSE = 2
PANEL_DISPUTED = 1
