"""Fixed values of the scoring domain: sets, weights, thresholds. Each can be overridden where it is used."""

from typing import NamedTuple

# Fixed values.
MASS_TRANSIT = ("Rail", "HighSpeed Rail", "Metro", "LRT", "BRT")
RAIL_ONLY = ("Rail", "Suburban Rail", "Interurban Rail")
NON_RAIL = ("Metro", "LRT", "BRT", "HighSpeed Rail")
MODE_COLUMNS = ("BRT", "Cable Line", "Funicular", "HighSpeed Rail", "Interurban Rail", "LRT", "Metro", "Suburban Rail")
MODE_WEIGHTS = {
    "Funicular": 2.0,
    "Cable Line": 3.0,
    "BRT": 4.0,
    "LRT": 5.0,
    "Metro": 6.0,
    "Suburban Rail": 6.0,
    "Interurban Rail": 7.0,
    "HighSpeed Rail": 8.0,
    "Rail": 7.0,
    "Express Bus": 3.0,
    "Bus": 1.0,
}
MODE_ALIASES = {"Light Rail": "LRT", "HighSpeed": "HighSpeed Rail", "Interurban": "Interurban Rail", "Suburban": "Suburban Rail"}
NATIONAL, METROPOLITAN, LOCAL = "ארצי", "מטרופוליני", "עירוני"
TIERS = {NATIONAL: ("National", 3), METROPOLITAN: ("Metropolitan", 2), LOCAL: ("Local", 1)}
TIER_DEMAND = (50_000.0, 5_000.0)
MIN_PASSENGERS, MIN_MODES = 1_000.0, 2
DIVERSITY_BONUS = 0.10
#: In order: the first key that the text holds counts.
REGION_WEIGHTS = {
    "תל אביב": 0.0,
    "Tel Aviv": 0.0,
    "מרכז": 0.0,
    "Center": 0.0,
    "צפון": 1.0,
    "North": 1.0,
    "חיפה": 1.0,
    "Haifa": 1.0,
    "דרום": 1.0,
    "South": 1.0,
    "באר שבע": 1.0,
    "Jerusalem": 1.0,
    "ירושלים": 1.0,
}
POSITION_WEIGHTS = {
    "גלעין": 3.0,
    "Core": 3.0,
    "טבעת": 2.0,
    "First Ring": 2.0,
    "Inner Ring": 2.0,
    "Outer Ring": 2.0,
    "Middle Ring": 2.0,
    "צפון": 1.0,
    "חיפה": 1.0,
    "דרום": 1.0,
    "Outer": 1.0,
}
TERMINAL_WEIGHTS = {
    "חניון לילה": 1.0,
    "מסוף קטן": 2.0,
    "מסוף בינוני": 2.0,
    "מסוף גדול": 3.0,
    "מתקן משולב": 3.0,
    "National": 3.0,
    "Regional": 2.5,
    "Metropolitan": 2.0,
    "Local": 1.5,
    "Neighborhood": 1.0,
}
RING_MIDPOINTS, DECAY = (250.0, 750.0, 1250.0), 1.5
#: Share of jobs by tier; any other tier has the metropolitan one.
JOB_SHARE = {NATIONAL: 0.8, METROPOLITAN: 0.8, LOCAL: 0.2}
SCORE_MIN, SCORE_MAX = 1.0, 10.0
MC_ITERATIONS, MC_SEED, MC_TOP = 10_000, 42, 0.5
#: Random consistency index by matrix size; 1.49 beyond.
RANDOM_INDEX = {1: 0.0, 2: 0.0, 3: 0.58, 4: 0.90, 5: 1.12, 6: 1.24, 7: 1.32, 8: 1.41, 9: 1.45, 10: 1.49, 11: 1.51, 12: 1.48, 13: 1.56, 14: 1.57, 15: 1.59}
RANDOM_INDEX_BEYOND = 1.49
CONSISTENT = 0.10
SAATY = {
    1: "Equal importance",
    2: "Weak or slight",
    3: "Moderate importance",
    4: "Moderate plus",
    5: "Strong importance",
    6: "Strong plus",
    7: "Very strong importance",
    8: "Very, very strong",
    9: "Extreme importance",
}
#: Words an export cut short, and what they were.
TRUNCATED = {
    "גלעי": "גלעין",
    "טבעת פנימי": "טבעת פנימית",
    "טבעת חיצוני": "טבעת חיצונית",
    "טבעת תיכונ": "טבעת תיכונה",
    "תל אבי": "תל אביב",
    "מרכ": "מרכז",
    "צפו": "צפון",
    "דרו": "דרום",
    "חיפ": "חיפה",
    "ירושלי": "ירושלים",
    "באר שב": "באר שבע",
}
OVERLAYS = ("Hadera", "HaifaMetronit")
#: In order: each keyword the text holds adds its models.
CANDIDATE_MODELS = (
    (("חיפ", "Haifa", "צפון", "North"), ("Haifa",)),
    (("תל אבי", "תל-אבי", "Tel Aviv", "TelAviv", "מרכז", "Center"), ("TelAviv",)),
    (("ירושלי", "Jerusalem"), ("Jerusalem",)),
    (("דרום", "South"), ("BeerSheva", "Ashdod", "Ashkelon")),
    (("באר שב", "Beer Sheva", "BeerSheva"), ("BeerSheva",)),
    (("אשדוד", "Ashdod"), ("Ashdod",)),
    (("אשקלון", "Ashkelon"), ("Ashkelon",)),
)
SHEET_REGIONS = {
    "5040_daily": "Haifa",
    "daily_5087": "Tel Aviv",
    "daily_bs": "Beer Sheva",
    "daily_hadera": "Hadera",
    "daily_jerusalem": "Jerusalem",
    "haifanewmetronit": "Haifa Metronit",
    "daily_5093": "Ashdod-Ashkelon",
    "national": "Rail",
}
NODE_OVERRIDES = ((400424, 64985.0, 43032.0), (400021, 23083.0, 10140.0), (400030, 14518.0, 6101.0), (511246, 13601.0, 6101.0), (511248, 255.3, None))
MODE_LABELS_HE = {"Rail": "רכבת", "HighSpeed Rail": "רכבת מהירה", "Interurban Rail": "רכבת בינעירונית", "Suburban Rail": "רכבת פרברית", "Metro": "מטרו", "LRT": 'רק"ל', "BRT": "BRT"}


class RegionColumns(NamedTuple):
    """Where a model's sheet has what; transfers add up."""

    node: str
    boardings: str
    alightings: str
    transfers: tuple[str, ...] = ()


# The columns of each model's sheet, and of any other.
REGION_COLUMNS = {
    "Beer Sheva": RegionColumns("NODE_ID", "Boardings", "Alightings"),
    "Hadera": RegionColumns("NodeID", "On", "Off"),
    "Tel Aviv": RegionColumns("Node", "TotalBoardings", "TotalAlight", ("TransferBoardings", "TransferAlight")),
    "Ashdod-Ashkelon": RegionColumns("Node", "InitialBoardings", "FinalAlight"),
    "Haifa": RegionColumns("Node", "TotalBoardings", "TotalAlight", ("TransferBoardings", "TransferAlight")),
    "Haifa Metronit": RegionColumns("ModelNode", "Boardings_Daily", "Alightings_Daily"),
    "Jerusalem": RegionColumns("ID", "DailyBoard_2050", "DailyAlight_2050"),
    "Rail": RegionColumns("Node", "Boardings", "Alightings"),
}
REGION_DEFAULT = RegionColumns("Node", "Boardings", "Alightings", ("TotalTransfers",))
#: Lines of one area that no analysis counts.
DROPPED_AREA, DROPPED_LINES = "Netanya", ("LRT151", "LRT152")
#: A group that was merged by hand, and into which.
MERGED_GROUPS = {577: 576}
AREAS_BY_FIRST_WORD = {"תל": "תל אביב", "באר": "באר שבע"}
