"""Rule tables and overrides of the nest survey."""

from __future__ import annotations

# Evidence in the notes that a nest is from an earlier year; first match decides.
OLD_NEST = [
    ("regex", "(?i)old nest", "yes"),
    ("regex", "maybe old", "no"),
    ("regex", "confirmed old", "yes"),
    ("regex", "nest old", "yes"),
]

# Evidence that a nest was not monitored; exceptions stand before the general rule.
MONITORED = [
    ("regex", "(?i)outside search area", "no"),
    ("equals", "too high to swab if parasitized, no ladder access", "yes"),
    ("equals", "need ladder to swab", "yes"),
    ("regex", "(?i)ladder", "no"),
    ("equals", "Not accessible at all", "no"),
    ("equals", "Too high to monitor", "no"),
    ("equals", "Too high to collect data (More than 5 meters)", "no"),
    ("equals", "nest too high to acess", "no"),
]

# Spellings of tree species.
TREE_SPECIES = {
    "dwarf raspberry": "raspberry",
    "dwarf raspberrry": "raspberry",
    "choke cherry": "chokecherry",
    "Red-berried elder": "red-berried elder",
    "Peach willow": "peachleaf willow",
    "peach willow": "peachleaf willow",
    "Box elder": "box elder",
    "N/A": None,
    "na": None,
    "NA": None,
    "Cat tail": "cat tail",
    "dead tree": "dead plant",
    "dead bush": "dead plant",
}

# Site by id prefix, then by exact id; host species of the study.
SITE_PREFIXES = [("^a", "dwf"), ("^j", "dwf"), ("^e", "pcc"), ("^r02$", "pcc"), ("^r01", "dwf")]
SITE_EXACT = [
    ("e6", "dwf"),
    ("a1", "pcc"),
    ("a2", "pcc"),
    ("j2", "pcc"),
    ("j6", "outside study area"),
    ("e5", "outside study area"),
    ("a4", "outside study area"),
]
SITES = ["pcc", "dwf"]
TARGET_SPECIES = "AMRO$|RWBL$|GRCA$|YEWA$"

# Spellings in the log columns.
ADULT = {"Yes": "yes", "yes h": "yes", "NA": None, "n/a": None, "?": None, "unknown": None}
STAGE = {
    "Laying/Incubation": "laying/incubating",
    "Ready to Lay": "ready to lay",
    "Do Not Monitor (note)": "do not monitor (note)",
    "Incubating": "incubating",
    "Laying": "laying",
    "Building": "building",
    "Hatched": "hatching",
    "Unknown (note)": "unknown (note)",
    "DNM": "do not monitor (note)",
    "ready to Lay": "ready to lay",
    "NA": None,
    "hatched": "hatching",
    "laying/incubation": "laying/incubating",
    "REady to Lay": "ready to lay",
    "do Not Monitor (note)": "do not monitor (note)",
    "unknown": "unknown (note)",
    "Unknown": "unknown (note)",
    "REady to lay": "ready to lay",
    "do not Monitor (note)": "do not monitor (note)",
    "incubation": "incubating",
    "Do not Monitor (note)": "do not monitor (note)",
    "do not monitor": "do not monitor (note)",
    "see notes": "unknown (note)",
    "? see notes": "unknown (note)",
    "incubating/hatched": "incubating/hatching",
    "incubating?": "incubating",
}
NEW_PARASITISM = {"n/a": None, "na": None, "u": None, "bo": "no", "n": "no", "NA": None, "unknown": None}
BHCO_SWAB = {"n/a": None, "na": None, "u": None, "n": "no", "NA": None}
HOST_SWAB = {"n/a": None, "na": None, "u": None, "n": "no", "NA": None, "Yes": "yes"}
PREDATED = {
    "n/a": None,
    "na": None,
    "u": None,
    "n": "no",
    "NA": None,
    "Unknown": None,
    "unknown": None,
    "yes (see notes)": "yes",
    "yes(see notes)": "yes",
}

# Weather, damage and other events in the notes.
WEATHER = [
    ("equals", "3 hatched, 2 eggs. Swab day 10 missed on rain day, no access.", "no"),
    ("regex", "(?i)wind(?!y)", "yes"),
    ("regex", "(?i)rain", "yes"),
    ("regex", "(?i)storm", "yes"),
]
DAMAGE = [
    ("regex", "(?i)no nest destruction", "no"),
    ("regex", "(?i)no nest damage", "no"),
    (
        "equals",
        "I don't know what happen but I wrote that the nest was damaged without eggs the 0612 and found a nest "
        "in the same GPS point with 2 eggs today. New nest?",
        "no",
    ),
    ("regex", "(?i)damaged", "yes"),
    ("regex", "(?i)destroyed", "yes"),
    ("regex", "(?i)turned on side", "yes"),
    ("regex", "(?i)messed up", "yes"),
    ("regex", "(?i)pulled apart", "yes"),
    ("regex", "(?i)disheveled", "yes"),
    ("regex", "(?i)detsroyed", "yes"),
    ("regex", "(?i)torn off", "yes"),
    ("regex", "(?i)pulled up", "yes"),
    ("regex", "(?i)nest tipped over", "yes"),
]
DESERTED = "likely deserted|nest deserted"
BURIED = "nest buried"
ADDLED = "(?i)dud|addeled|addled"

# Maxima corrected by hand, with the reason.
MAX_HOST_EGG = [
    ("a49", 5, "5 eggs were laid with one removed during laying"),
    ("e30", 5, "5 eggs were laid with three lost during laying"),
    ("a65", 5, "5 eggs were laid with one removed during laying"),
    ("a25", 2, "2 eggs were laid with one predated during laying"),
    ("e100", 7, "7 eggs were laid with one predated during laying"),
]
MAX_HOST_HATCH = [("a92", 5, "5 eggs hatched with 3 hatchlings predated")]
UNKNOWN_PROPORTION = ["a11"]
UNKNOWN_OUTCOME = ["e128", "j42", "j44", "j58"]

# Average days of incubation and the publication they are taken from, as the output column has it.
INCUBATION = [
    ("AMRO", 12, "Ospina, E. A., Merrill, L., &amp; Benson, T. J. (2018). Incubation temperature impacts nestling growth and survival in an open-cup nesting passerine. Ecology and Evolution, 8(6), 3270–3279. https://doi.org/10.1002/ece3.3911"),
    ("GRCA", 13, "Johnson, E. J. and L. B. Best. (1980). Breeding biology of the Gray Catbird in Iowa. Iowa State J. Res. 55:171-183."),
    ("YEWA", 11, "McMaster, D. G., & Sealy, S. G. (1998). Short incubation periods of Brown-headed Cowbirds: How do cowbird eggs hatch before Yellow Warbler eggs?. The Condor, 100(1), 102-111."),
    ("RWBL", 12, "Birds of the world: Yasukawa, K. and W. A. Searcy (2020). Red-winged Blackbird (Agelaius phoeniceus), version 1.0. In Birds of the World (P. G. Rodewald, Editor). Cornell Lab of Ornithology, Ithaca, NY, USA. https://doi-org.proxy1.lib.uwo.ca/10.2173/bow.rewbla.01"),
]
BHCO_INCUBATION = (12, "McMaster, D. G., & Sealy, S. G. (1998). Short incubation periods of Brown-headed Cowbirds: How do cowbird eggs hatch before Yellow Warbler eggs?. The Condor, 100(1), 102-111.")

# Host eggs counted in a sample of the pilot, and its replacement for a missing taxon.
MAX_COHORT_EGGS = 3
UNKNOWN_TAXON = "Unknown Bacteria"
TAXON_LEVELS = ["asv_name", "kingdom", "phylum", "class", "order", "family", "genus", "species"]
