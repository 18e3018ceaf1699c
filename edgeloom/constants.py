"""Fixed values of the domain: results depend on them, so they are kept as they are."""

# Node types in order of priority; "Entity" is the fallback.
TYPE_PRIORITY = [
    "Gene", "Protein", "Drug", "Disease", "Cytokine", "Cell", "Pathway", "Metabolite",
    "Hormone", "Process", "ECM", "Concept", "Article", "Entity",
]

# Name fragment -> canonical entity, first match wins.
ENTITY_FORMS = [
    ("f2rl1", "F2RL1 (PAR-2)"),
    ("par-2", "F2RL1 (PAR-2)"),
    ("par2", "F2RL1 (PAR-2)"),
    ("proteinase-activated receptor 2", "F2RL1 (PAR-2)"),
    ("protease-activated receptor 2", "F2RL1 (PAR-2)"),
    ("coagulation factor ii receptor-like 1", "F2RL1 (PAR-2)"),
]

# Terms of well-known genes of the disease.
TEXTBOOK_TERMS = [
    "f2", "prothrombin", "thrombin", "f5", "f7", "f8", "f9", "f10", "f11", "f12", "f13", "tf",
    "tissue factor", "vwd", "vwf", "von willebrand", "adamts13", "protein c", "protein s",
    "antithrombin", "serpine1", "pai-1", "tfp1", "thrombomodulin", "epcr", "fibrinogen", "fibrin",
    "fga", "fgb", "fgg", "plasminogen", "plg", "tpa", "plasmin", "p-selectin", "selectin",
    "factor v leiden", "prothrombin 20210", "mthfr", "jak2", "hmgb1", "padi4", "albumin",
    "glucose", "cholesterol", "triglyceride",
]

# Terms of mechanism genes.
MECHANISM_TERMS = [
    "fut8", "lgals3", "galectin-3", "cd44", "itgb1", "itga5", "itgav", "mapk1", "mapk3", "rhoa",
    "rock1", "rock2", "nfkb1", "rela",
]

# Anchor name fragment -> symbol, first match wins.
ANCHOR_FORMS = [
    ("rhoa", "RHOA"), ("rock1", "ROCK1"), ("rock2", "ROCK2"), ("mapk1", "MAPK1"),
    ("mapk3", "MAPK3"), ("nfkb1", "NFKB1"), ("rela", "RELA"), ("cd44", "CD44"),
    ("itgb1", "ITGB1"), ("itga5", "ITGA5"), ("fut8", "FUT8"), ("lgals3", "LGALS3"),
]

# Pathway tag -> terms, in tag order.
PATHWAY_TERMS = {
    "Inflammation": ["inflamm", "cytokine", "il-", "tnf", "nf-kb", "tlr", "chemokine"],
    "Fibrosis": ["fibrosis", "fibrotic", "tgf", "sma", "collagen", "mmp", "timp", "ctgf"],
    "Metabolism": ["metabol", "lipid", "glucose", "insulin", "cholesterol", "fatty acid"],
    "Epigenetics": ["methyl", "acetyl", "hdac", "sirt", "mir", "lncrna", "histone"],
    "Oxidative Stress": ["oxid", "ros", "nadph", "nox", "sod", "catalase", "glutathione"],
    "Autophagy/Apoptosis": ["autophagy", "apoptosis", "caspase", "bcl", "bax", "beclin"],
}

# Category -> pattern; a later category overrides an earlier one.
CATEGORY_PATTERNS = [
    ("Coagulation", "coagul|thrombin|factor|fibrin|prothrombin|plasmin|fxa|factor x"),
    ("Inflammation", "tlr|nf-kb|inflamm|p-selectin|cytokine|il-|tnf|enos|pai-1|egfr|ace2"),
    ("Fibrosis/TGFB", "smad|tgf|col|fn1|acta|fibrosis|runx|dnmt|gata|prkc"),
    ("Vascular Signaling", "vegf|vegfr|pdgfr|kit|alk1|endoglin"),
]

# Pattern of the second pathway axis and the two axis labels.
FIBROSIS_AXIS_PATTERN = (
    "smad|runx|dnmt|prkc|gata|san gene|vwf transc|factor v leiden|pomc|mir-155|col|fn1|acta"
)
PATHWAY_AXES = ("TLR4/Inflammation", "TGFB/Fibrosis")

# Relation name -> attention temperature, later rows win; others 1.0.
TEMPERATURES = [
    ("REGULATES", 0.5), ("ACTIVATES", 0.5), ("BINDS_TO", 0.5), ("INHIBITS", 0.5),
    ("PARTICIPATES_IN", 0.7), ("ENCODES", 0.7),
    ("ASSOCIATED_WITH", 1.0), ("INTERACTS_WITH", 1.0), ("UPREGULATES", 1.0),
    ("DOWNREGULATES", 1.0),
    ("PROMOTES", 2.0), ("TARGETS", 2.0),
]
MIN_TEMPERATURE = 0.01

# Hub protection.
HUB_DEGREE = 1000
HUB_NAMES = ["Thrombin", "Thrombosis", "Inflammation", "F2", "VTE"]

# Temporal windows.
TEMPORAL_WINDOWS = dict(train_end="2024-12-31", val_start="2025-01-01", val_end="2025-06-30",
                        test_start="2025-07-01", test_end="2026-06-30")

# Gene programs of the expression maps.
GENE_PROGRAMS = {
    "Inflammation Axis": ["Tlr4", "Nfkb1", "Rela", "Stat3", "Spp1", "Tnf", "Il6", "Ccl2", "Sell"],
    "Fibrosis Axis": ["Smad4", "Runx2", "Dnmt3a", "Prkca", "Fn1", "Col1a1", "Acta2"],
    "TGFB Ligand": ["Tgfb1"],
}
