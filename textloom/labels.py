"""Label dictionaries used by the task shapes.

FIXED VALUES: these lists must equal the reference's label sets, element for
element and in this order, because a label id is its index in the list.
"""

from __future__ import annotations

# ---- fixed values (order matters: index = label id) ----
TOPIC_CLASSES = ["IT과학", "경제", "사회", "생활문화", "세계", "스포츠", "정치", "해당없음"]
NLI_CLASSES = ["entailment", "neutral", "contradiction"]
CHAR_NER_TYPES = ["DT", "LC", "OG", "PS", "QT", "TI"]
RELATION_CLASSES = [
    "no_relation",
    "org:dissolved",
    "org:founded",
    "org:place_of_headquarters",
    "org:alternate_names",
    "org:member_of",
    "org:members",
    "org:political/religious_affiliation",
    "org:product",
    "org:founded_by",
    "org:top_members/employees",
    "org:number_of_employees/members",
    "per:date_of_birth",
    "per:date_of_death",
    "per:place_of_birth",
    "per:place_of_death",
    "per:place_of_residence",
    "per:origin",
    "per:employee_of",
    "per:schools_attended",
    "per:alternate_names",
    "per:parents",
    "per:children",
    "per:siblings",
    "per:spouse",
    "per:other_family",
    "per:colleagues",
    "per:product",
    "per:religion",
    "per:title",
]
ENTITY_TYPES = ["PER", "ORG", "POH", "DAT", "LOC", "NOH"]
NE_TYPES = ["PS", "LC", "OG", "DT", "TI", "QT", "AF", "CV", "AM", "PT", "FD", "TR", "EV", "MT", "TM"]
ACCEPTABILITY_CLASSES = ["unacceptable", "acceptable"]
UTTERANCE_CLASSES = [
    "fragment",
    "statement",
    "question",
    "command",
    "rhetorical question",
    "rhetorical command",
    "intonation-depedent utterance",
]
SPAN_TAGS = ["O", "B", "I"]
DEP_SYNTAX = ["NP", "VP", "AP", "VNP", "DP", "IP", "X", "L", "R"]
DEP_FUNCTIONS = ["SBJ", "OBJ", "MOD", "AJT", "CMP", "CNJ"]
DEP_RELATIONS = [
    "NP", "NP_AJT", "VP", "NP_SBJ", "VP_MOD", "NP_OBJ", "AP", "NP_CNJ", "NP_MOD", "VNP", "DP", "VP_AJT", "VNP_MOD", "NP_CMP", "VP_SBJ", "VP_CMP",
    "VP_OBJ", "VNP_CMP", "AP_MOD", "X_AJT", "VNP_AJT", "VP_CNJ", "IP", "X", "VNP_OBJ", "X_SBJ", "X_OBJ", "VNP_SBJ", "L", "AP_AJT", "X_CMP",
    "X_CNJ", "X_MOD", "AP_CMP", "R", "VNP_CNJ", "AP_SBJ", "NP_SVJ",
]
# ---- end of fixed values ----


# The 150 types of the wide named-entity set.
NE_WIDE_TYPES = [
    "PS_NAME", "PS_CHARACTER", "PS_PET", "FD_SCIENCE", "FD_SOCIAL_SCIENCE", "FD_MEDICINE", "FD_ART",
    "FD_HUMANITIES", "FD_OTHERS", "TR_SCIENCE", "TR_SOCIAL_SCIENCE", "TR_MEDICINE", "TR_ART", "TR_HUMANITIES",
    "TR_OTHERS", "AF_BUILDING", "AF_CULTURAL_ASSET", "AF_ROAD", "AF_TRANSPORT", "AF_MUSICAL_INSTRUMENT",
    "AF_WEAPON", "AFA_DOCUMENT", "AFA_PERFORMANCE", "AFA_VIDEO", "AFA_ART_CRAFT", "AFA_MUSIC",
    "AFW_SERVICE_PRODUCTS", "AFW_OTHER_PRODUCTS", "OGG_ECONOMY", "OGG_EDUCATION", "OGG_MILITARY", "OGG_MEDIA",
    "OGG_SPORTS", "OGG_ART", "OGG_MEDICINE", "OGG_RELIGION", "OGG_SCIENCE", "OGG_LIBRARY", "OGG_LAW",
    "OGG_POLITICS", "OGG_FOOD", "OGG_HOTEL", "OGG_OTHERS", "LCP_COUNTRY", "LCP_PROVINCE", "LCP_COUNTY", "LCP_CITY",
    "LCP_CAPITALCITY", "LCG_RIVER", "LCG_OCEAN", "LCG_BAY", "LCG_MOUNTAIN", "LCG_ISLAND", "LCG_CONTINENT",
    "LC_SPACE", "LC_OTHERS", "CV_CULTURE", "CV_TRIBE", "CV_LANGUAGE", "CV_POLICY", "CV_LAW", "CV_CURRENCY",
    "CV_TAX", "CV_FUNDS", "CV_ART", "CV_SPORTS", "CV_SPORTS_POSITION", "CV_SPORTS_INST", "CV_PRIZE", "CV_RELATION",
    "CV_OCCUPATION", "CV_POSITION", "CV_FOOD", "CV_DRINK", "CV_FOOD_STYLE", "CV_CLOTHING", "CV_BUILDING_TYPE",
    "DT_DURATION", "DT_DAY", "DT_WEEK", "DT_MONTH", "DT_YEAR", "DT_SEASON", "DT_GEOAGE", "DT_DYNASTY", "DT_OTHERS",
    "TI_DURATION", "TI_HOUR", "TI_MINUTE", "TI_SECOND", "TI_OTHERS", "QT_AGE", "QT_SIZE", "QT_LENGTH", "QT_COUNT",
    "QT_MAN_COUNT", "QT_WEIGHT", "QT_PERCENTAGE", "QT_SPEED", "QT_TEMPERATURE", "QT_VOLUME", "QT_ORDER", "QT_PRICE",
    "QT_PHONE", "QT_SPORTS", "QT_CHANNEL", "QT_ALBUM", "QT_ADDRESS", "QT_OTHERS", "EV_ACTIVITY",
    "EV_WAR_REVOLUTION", "EV_SPORTS", "EV_FESTIVAL", "EV_OTHERS", "AM_INSECT", "AM_BIRD", "AM_FISH", "AM_MAMMALIA",
    "AM_AMPHIBIA", "AM_REPTILIA", "AM_TYPE", "AM_PART", "AM_OTHERS", "PT_FRUIT", "PT_FLOWER", "PT_TREE", "PT_GRASS",
    "PT_TYPE", "PT_PART", "PT_OTHERS", "MT_ELEMENT", "MT_METAL", "MT_ROCK", "MT_CHEMICAL", "TM_COLOR",
    "TM_DIRECTION", "TM_CLIMATE", "TM_SHAPE", "TM_CELL_TISSUE_ORGAN", "TMM_DISEASE", "TMM_DRUG", "TMI_HW", "TMI_SW",
    "TMI_SITE", "TMI_EMAIL", "TMI_MODEL", "TMI_SERVICE", "TMI_PROJECT", "TMIG_GENRE", "TM_SPORTS",
]


def iob2(types: list[str], outside_first: bool) -> list[str]:
    """IOB2 tag list built by rule: B-x, I-x per type, with O first or last."""
    body = [f"{p}-{t}" for t in types for p in ("B", "I")]
    return ["O", *body] if outside_first else [*body, "O"]


# The character-NER set puts O last; the word-NER sets put O first.
CHAR_NER_IOB2 = iob2(CHAR_NER_TYPES, outside_first=False)
NE_IOB2 = iob2(NE_TYPES, outside_first=True)
NE_WIDE_IOB2 = iob2(NE_WIDE_TYPES, outside_first=True)
