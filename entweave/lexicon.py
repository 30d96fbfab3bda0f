"""Constants that are part of the semantics: edge scores, typing rules, stop words and name lexicons."""

from __future__ import annotations

#: score -> predicates; every other predicate scores DEFAULT_PREDICATE
_BY_SCORE = {
    54: "P166", 68: "P527", 70: "P710 P463", 72: "P170 P206", 73: "P102", 74: "P276 P740 P355", 75: "P749 P641", 76: "P407 P31",
    77: "P264", 78: "P123 P86", 79: "P108 P69", 80: "P361 P30", 82: "P400 P279", 84: "P127", 85: "P112", 86: "P105",
    88: "P39 P178 P176 P175", 89: "P57 P50", 90: "P452 P136 P495", 91: "P159", 92: "P131 P27 P17", 94: "P171", 95: "P106",
}
PREDICATE_SCORES = {p: score for score, names in _BY_SCORE.items() for p in names.split()}
DEFAULT_PREDICATE = 32

_BONUS = """
BIOLOGICAL_TAXON P31+4 P105+16 P171+20; BOOK P50+8; COMPANY P127+4 P159+6 P452+8;
EVENT P31-4 P361+8 P641+10 P710+10 P131+12 P17+12 P276+16; FILM P175+4 P57+8;
LOCATION P31-2 P206+8 P30+10 P361+14 P131+18 P17+20; MUSIC_WORK P264+4 P86+6 P175+8;
ORGANIZATION P31-4 P463+4 P740+8 P355+10 P17+10 P131+10 P749+12 P127+12 P112+12 P159+16 P452+18;
PERSON P31-6 P463+6 P102+8 P108+10 P69+10 P27+14 P39+16 P106+18; PREDICATE P279+6 P31+8;
PRODUCT P495+8 P400+10 P178+10 P176+18; SOFTWARE P31-2 P136+8 P400+16 P178+18; TYPE P31+4 P279+12;
WORK P31-4 P495+8 P407+8 P400+10 P264+10 P123+10 P86+12 P170+12 P175+14 P57+14 P50+14 P136+16
"""


def _bonuses() -> dict[tuple[str, str], int]:
    out = {}
    for line in _BONUS.replace("\n", " ").split(";"):
        profile, *parts = line.split()
        for part in parts:
            cut = max(part.find("+"), part.find("-"))
            out[profile, part[:cut]] = int(part[cut:])
    return out


PROFILE_BONUS = _bonuses()
RANK_BONUS = {"preferred": 8, "normal": 0, "deprecated": -12}
RANK_ORDER = {"preferred": 0, "normal": 1, "deprecated": 2}
PROPERTY_OBJECT_PENALTY = 28
HUMAN_PENALTY = 6
#: fine types that imply a profile
FAMILY_OF = {
    fine: family
    for family, names in {
        "EVENT": "EVENT_GENERIC SPORT_EVENT CONFLICT",
        "PRODUCT": "PRODUCT_GENERIC FOOD_BEVERAGE MEDICATION DEVICE",
        "WORK": "INTERNET_MEME SOFTWARE MUSIC_WORK BOOK FILM",
        "LOCATION": "CELESTIAL_BODY LANDMARK REGION CITY COUNTRY",
        "ORGANIZATION": "SPORTS_TEAM EDUCATIONAL_ORG GOVERNMENT_ORG NONPROFIT_ORG COMPANY",
    }.items()
    for fine in names.split()
}
MAX_EDGES, MAX_EDGES_PER_PREDICATE = 12, 2

STOPWORDS = sorted(
    "zu y with von uno und una un to the per or on of los lo les le las la is in il i gli from for et eine ein en el e du die di des der del de das by be at as are and an a".split()
)

#: (coarse, fine, least score, token clues, phrase clues)
TYPING_RULES: list[tuple[str, str, int, list[str], list[str]]] = [
    (coarse, fine, least, sorted(tokens.split()), [p.strip() for p in phrases.split(",") if p.strip()])
    for coarse, fine, least, tokens, phrases in [
        ("CONCEPT", "ANATOMY", 2, "vein artery bone muscle anatomical anatomy organ", "anatomical structure, sexual organ, part of body, part of the body"),
        ("CONCEPT", "BIOLOGICAL_TAXON", 1, "mammal clade subspecies taxon genus species", ""),
        ("CONCEPT", "SCIENTIFIC_THEORY", 1, "hypothesis theorem equation principle theory", ""),
        ("CONCEPT", "LAW", 2, "code constitution directive regulation treaty statute law", "regulation of, treaty of, act of, law of"),
        ("CONCEPT", "LANGUAGE", 1, "dialect language", ""),
        ("PRODUCT", "PRODUCT_GENERIC", 1, "model brand product", ""),
        ("PRODUCT", "FOOD_BEVERAGE", 1, "nonalcoholic non-alcoholic alcoholic meal snack cuisine dish food drink beverage", "non-alcoholic beverage, alcoholic beverage"),
        ("PRODUCT", "MEDICATION", 1, "treatment antibiotic vaccine medicine drug", ""),
        ("PRODUCT", "DEVICE", 1, "train printer automobile airliner aircraft vehicle hardware laptop phone smartphone device", ""),
        ("WORK", "INTERNET_MEME", 1, "meme", "internet meme"),
        ("WORK", "SOFTWARE", 1, "framework library program app application software", "operating system"),
        ("WORK", "MUSIC_WORK", 1, "anthem symphony opera album song", ""),
        ("WORK", "BOOK", 1, "literature poem novel book", ""),
        ("WORK", "FILM", 1, "cinema documentary movie film", ""),
        ("EVENT", "EVENT_GENERIC", 2, "summit election conference festival event", ""),
        ("EVENT", "SPORT_EVENT", 2, "season cup olympics championship tournament", ""),
        ("EVENT", "CONFLICT", 2, "campaign uprising revolution battle war", "civil war, military conflict, armed conflict"),
        ("LOCATION", "CELESTIAL_BODY", 1, "universe comet asteroid galaxy star moon planet", "celestial body, solar system"),
        ("LOCATION", "LANDMARK", 1, "volcano valley desert monument building bridge station airport island lake river mountain strait bay gulf sea ocean", ""),
        ("LOCATION", "REGION", 1, "continent territory county district province region", "autonomous region, federal state, state in the united states, state of the united states"),
        ("LOCATION", "CITY", 1, "municipio comune stadt ciudad cidade settlement suburb borough arrondissement commune megacity metropolis village capital municipality town city",
         "largest city, primate city, national capital, global city, census-designated place, county seat, capital of, village in, town in, city in"),
        ("LOCATION", "COUNTRY", 1, "sovereign kingdom republic nation country", "country in, independent state, sovereign state"),
        ("ORGANIZATION", "SPORTS_TEAM", 1, "hockey soccer baseball basketball athletic fc team", "football club"),
        ("ORGANIZATION", "EDUCATIONAL_ORG", 1, "academy institute school college university", ""),
        ("ORGANIZATION", "GOVERNMENT_ORG", 1, "municipality council senate parliament agency department ministry government", ""),
        ("ORGANIZATION", "NONPROFIT_ORG", 1, "ngo non-profit nonprofit charitable foundation", "non-profit organization, charitable organization"),
        ("ORGANIZATION", "COMPANY", 1, "multinational firm startup enterprise manufacturer business corporation company", ""),
        ("PERSON", "FICTIONAL_CHARACTER", 2, "protagonist villain superhero character fictional", "fictional character"),
        ("PERSON", "PERSON", 1, "professor founder president composer doctor engineer journalist philosopher poet filmmaker director artist scientist footballer athlete author writer politician musician singer actress actor person",
         "president of, head of state, prime minister, human being"),
    ]
]

NO_ARTICLE_SITES = [f"{x}wiki" for x in "wikidata test strategy species outreach meta mediawiki incubator foundation commons".split()]
DISAMBIGUATION_TYPES = ["Q22808320", "Q4167410"]
CLASS_TYPES = ["Q24017414", "Q16889133"]

DESCRIPTOR = sorted(
    "landmark body great geography inland salt freshwater water port harbour harbor border region province state country village town city volcano peak mountain island strait gulf bay basin river ocean sea lakes lake".split()
)
META = sorted("list level tour map history encyclopedia journal paper article wikimedia wikipedia template module category".split())
OFF_DOMAIN = sorted("highway motorway bus line route plant power airport railway metro station ship".split())
WATER = sorted("freshwater water lagoon reservoir strait gulf bay river ocean sea lakes lake".split())
CREATIVE = sorted("series opera drawing artwork photograph sculpture poem novel book album song movie film painting".split())
SCHOLARLY = sorted("scholarly review proceedings study journal paper article".split())
DERIVATIVE = sorted("timeline chronology list atlas encyclopedia level tour map history".split())
QUALIFIER_STOP = sorted("to the on of n in from for by at and an a".split())
SUPPORT_STOP = sorted([*QUALIFIER_STOP, "notes", "note"])

COUNTRIES = sorted(
    x.replace("_", " ")
    for x in "mexico japan china india brazil spain italy germany france tanzania kenya uganda belgium azerbaijan turkmenistan russia kazakhstan iran new_zealand australia guyana canada united_kingdom united_states".split()
)
WATER_HINTS = sorted("basin strait bay gulf river ocean sea lake".split())
POLYSEMOUS = sorted("gaga viper victoria houston obsession savannah gauge".split())

#: labels that schemas from outside may use, and what stands for them
ITEM_CATEGORIES = sorted("SENSE FORM LEXEME MEDIAINFO PREDICATE TYPE DISAMBIGUATION OTHER ENTITY".split())
COARSE_TYPES = sorted("RELATION THING MISC EVENT WORK PRODUCT LOCATION PERSON ORGANIZATION BIOLOGICAL_TAXON".split())
FINE_TYPES = sorted({fine for _, fine, *_ in TYPING_RULES} - set("LAW ANATOMY LANGUAGE SCIENTIFIC_THEORY".split()) | set("MISC PERSON PROPERTY HUMAN COSMOLOGICAL_ENTITY".split()))
_WATER_LABELS = "BODY_OF_WATER LAKE RIVER SEA WATERBODY MOUNTAIN"
_PLACE_LABELS = "GEOGRAPHICALFEATURE GEOGRAPHICFEATURE PLACE"
ITEM_SYNONYMS = dict.fromkeys([*_PLACE_LABELS.split(), "LOCATION"], "ENTITY")
COARSE_SYNONYMS = dict.fromkeys([*_PLACE_LABELS.split(), *_WATER_LABELS.split()], "LOCATION")
FINE_SYNONYMS = dict.fromkeys([*_WATER_LABELS.split(), *"STRAIT GULF OCEAN BAY MONUMENT ISLAND BUILDING BRIDGE AIRPORT".split()], "LANDMARK") | {"PERSON": "HUMAN"}
