"""Word lists and patterns. They are data: every operator takes another list in their place."""

# Words that are not indexed.
STOPWORDS = tuple(
    """the a an and or of in on at to for with from by as about into if but so such than then there here
    is are was were be been being am have has had do does did will would shall should must
    it its this that these those my our their his her i we you they them he she him us me
    how what when where why who whom whose which
    all any each some more most other only just very too also no not""".split()
)

# Plurals that no suffix rule reaches.
IRREGULAR = {
    "men": "man", "women": "woman", "children": "child", "buses": "bus", "leaves": "leaf", "calves": "calf",
    "wolves": "wolf", "mice": "mouse", "geese": "goose", "feet": "foot", "teeth": "tooth",
}

# The closed list of subject tags.
SUBJECTS = (
    "railway", "bazaar", "river", "school", "temple", "monsoon", "farmland", "street food", "bus", "coastline", "hills",
    "festival", "wildlife", "old town", "highway", "dance", "music", "ceremony", "village", "flowers", "forest", "fort",
    "aerial", "crafts", "industry", "sport", "politics", "snow", "birds", "livestock", "architecture", "boats", "desert",
    "lake",
)

# Alias and canonical spelling of one word or place.
SYNONYMS = {
    "bombay": "mumbai", "calcutta": "kolkata", "madras": "chennai", "bangalore": "bengaluru", "poona": "pune",
    "benares": "varanasi", "banaras": "varanasi", "kashi": "varanasi", "cochin": "kochi", "trivandrum": "thiruvananthapuram",
    "mysore": "mysuru", "simla": "shimla", "ootacamund": "ooty", "pondicherry": "puducherry", "baroda": "vadodara",
    "cawnpore": "kanpur", "pooja": "puja", "deepavali": "diwali", "ganesha": "ganesh", "gurdwara": "gurudwara",
    "masjid": "mosque", "mandir": "temple", "saree": "sari", "allahabad": "prayagraj",
}

# Titles of people speaking to the camera; (?i) where case does not count.
SPEAKING = (
    r"(?i)\b(?:talks?|talking|speaks?|speaking)\s+(?:on|about|to)\b",
    r"(?i)\binterviews?\b",
    r"(?i)\bin conversation with\b",
    r"(?i)\bopens up (?:on|about)\b",
    r"(?i)\b(?:recalls|reacts to|responds to)\b",
    r"(?i)\bpress (?:conference|meet)\b",
    r"(?i)\bon (?:his|her|their) (?:new |upcoming )?(?:film|movie|song|album|role|character|career)\b",
    r"(?i)\bshares (?:his|her|their)\b",
    r"(?i)\bbollywood\b",
    r"(?i)\bitem (?:song|number)\b",
    r"(?i)\bco-?stars?\b",
    r"(?i)\bstarrer\b",
    r"(?i)\b(?:film|movie|music|trailer|audio) (?:launch|promotion|premiere|release event)\b",
    r"(?i)\b(?:filmfare|iifa|stardust|screen awards|zee cine)\b",
    r"^[A-Z][a-z]+ [A-Z][a-z]+:.*\b(?:[Ff]ilm|[Mm]ovie|[Rr]ole|[Ss]ong|[Aa]lbum)\b",
    r"(?i)\bactress\b",
    r"^[A-Z][a-z]+:\s.*\b(?:[Ff]ilm|[Mm]ovie|[Rr]ole|[Ss]ong|[Aa]lbum|[Ss]tar)\b",
    r"(?i)\bcalendar launch\b",
    r"""^[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?:\s*['"]?\s*(?:I|My|Me|We|Our)\b""",
)

# Fixed value: queries that ask for people speaking.
ASKS_SPEAKING = (
    r"(?i)\b(?:interviews?|press\s+(?:conference|meet)|talks?\s+(?:on|about)|speaks?\s+(?:on|about)|in conversation|opens up"
    r"|bollywood|actor|actress|celebrity|film\s+star|item\s+(?:song|number)|filmfare|iifa|red\s+carpet|premiere)\b"
)

# One-word queries, and the personal names that they do not mean.
COLLISIONS = ((r"(?i)^meenakshi$", r"(?i)meenakshi\s+sh?eshadri"), (r"(?i)^kailash$", r"(?i)kailash\s+(?:kher|ji\b)"))

# Words before a place name that say where something is, and where it came from.
LOCATIVE = tuple("in at near outside inside around across along through over above below beside towards toward within throughout".split())
ORIGIN = tuple("from of native origin originates belongs".split())

# Words that carry no evidence in a title, and none in an answer.
TITLE_NOISE = tuple("the and of in at a an my for to".split())
ANSWER_STOP = tuple(
    """the a an and or of in on at to for with from by my me i is are was were be some any all more like want see seeing
    watch india indian something anything stuff things thing kind sort bit little somewhere else around near also really
    very just about lot lots back grew up live living born home feel feels curious explore mood old""".split()
)

# Far countries and cities in titles, and words that say home.
DISTANT = (
    r"(?i)\b(?:Finland|Helsinki|Netherlands|Keukenhof|Holland|Sweden|Norway|Denmark|Germany|Berlin|France|Italy|Lombardy|Rome|Spain|Portugal"
    r"|Switzerland|Austria|Salzburg|Vienna|Belgium|Poland|Greece|Istanbul|Ankara|Egypt|Kenya|Maasai\s+Mara|Serengeti|Tanzania|Morocco|Casablanca"
    r"|Tokyo|Australia|Canada|Mauritius|Hollywood|California|Washington\s+DC|New\s+York|Brazil|Mexico|Russia|Moscow|Ural)\b"
)
HOME_SIGNAL = r"(?i)\b(?:india|indian|indians|india's|indo|indo-\w+|bharat|himalaya|himalayan|himalayas)\b"

# Subjects that establish a place, best first.
ESTABLISHING = (
    "aerial", "architecture", "old town", "fort", "coastline", "hills", "river", "bazaar", "highway", "temple", "village", "farmland", "lake", "desert",
    "snow", "forest", "railway",
)

# Phrases that name a region, a state or a terrain.
REGION_PHRASES = {
    "north india": "North", "northern india": "North", "south india": "South", "southern india": "South",
    "east india": "East", "eastern india": "East", "west india": "West", "western india": "West",
    "central india": "Central", "northeast": "Northeast", "north east": "Northeast", "the northeast": "Northeast",
}
STATE_PHRASES = {
    "bengal": "West Bengal", "tamilnadu": "Tamil Nadu", "orissa": "Odisha", "uttaranchal": "Uttarakhand",
    "pondicherry": "Puducherry",
}
TERRAIN_PHRASES = {
    "mountain": ("hills",), "mountains": ("hills",), "hill": ("hills",), "hills": ("hills",), "himalaya": ("hills",),
    "himalayas": ("hills",), "coast": ("coastal",), "coastal": ("coastal",), "sea": ("coastal",), "ocean": ("coastal",),
    "beach": ("coastal",), "beaches": ("coastal",), "seaside": ("coastal",), "river": ("river valley", "delta"),
    "rivers": ("river valley", "delta"), "delta": ("delta",), "desert": ("desert",), "dunes": ("desert",),
    "plains": ("dry plains",), "plateau": ("plateau",),
}

# Carriers, formats and hashtags in titles; an archive's own codes and its channel's name are given as an argument.
TITLE_JUNK = (
    r"(?i)\b(?:DISC|TAPE|REEL)\s*\d+\b", r"(?i)\bFOOTAGE\s*$", r"\b(?:HD|4K|1080i?|HDCAM)\b", r"#\S+",
)

# The sentence forms of subjects.
SUBJECT_PHRASES = {
    "railway": "Trains and railway", "bazaar": "Market and bazaar", "river": "River and waterways", "school": "Schools",
    "temple": "Temples", "monsoon": "Monsoon rain", "farmland": "Farmland", "street food": "Street food", "bus": "Buses",
    "coastline": "The coast", "hills": "Hills", "festival": "Festival", "wildlife": "Wildlife", "old town": "The old town",
    "highway": "Roads and highways", "dance": "Dance", "music": "Music", "ceremony": "A ceremony", "village": "Village life",
    "flowers": "Flowers", "forest": "Forest", "fort": "A fort", "aerial": "Aerial views", "crafts": "Craft and handiwork",
    "industry": "Industry and work", "sport": "Sport", "politics": "A political gathering", "snow": "Snow", "birds": "Birds",
    "livestock": "Livestock", "architecture": "Buildings", "boats": "Boats", "desert": "Desert", "lake": "A lake",
}

# Titles that stand in for withdrawn videos, and the tail that descriptions share.
REJECTED = (("unavailable video", r"(?i)^\s*(?:private|deleted) video\s*$"),)
BOILERPLATE = r"(?is)\s*(?:This (?:footage|video) is part of|The collection comprises)\b.*$"


def subject_words() -> dict[str, tuple[str, ...]]:
    """Subjects by the words that name them, from a rule: the tag itself, its singular and its plural."""
    out: dict[str, tuple[str, ...]] = {}
    for s in SUBJECTS:
        one = s[:-1] if s.endswith("s") and not s.endswith("ss") and s != "bus" else s
        many = one + "es" if one.endswith(("s", "x", "ch", "sh")) else one[:-1] + "ies" if one.endswith("y") and one[-2:-1] not in "aeiou" else one + "s"
        for form in (s, one, many):
            if s not in out.get(form, ()):
                out[form] = (*out.get(form, ()), s)
    return out


def subject_keywords() -> list[tuple[str, str]]:
    """(subject, keyword) pairs of the same rule, for the tagger."""
    return sorted({(s, w) for w, subjects in subject_words().items() for s in subjects})
