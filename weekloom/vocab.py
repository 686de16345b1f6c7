"""Vocabulary of the football corpus, passed to the operators as plain data.

The values in this file are fixed: results depend on them being exactly these.
"""

# ---- fixed values -------------------------------------------------------------------

TEAM_IDS = {
    "Arsenal": 1,
    "Chelsea": 2,
    "Liverpool": 3,
    "Manchester City": 4,
    "Manchester United": 5,
    "Tottenham Hotspur": 6,
}

OUTLET_IDS = {"BBC": 1, "TheGuardian": 2, "SkySports": 3}

TOPICS = {
    0: "transfers/rumours",
    1: "financial/club news",
    2: "controversies",
    3: "tactics/analysis",
    4: "editorial/opinion",
    5: "human-interest/player events",
    6: "other",
}

# Inverse penalties tried for the topic model; 0 means no penalty.
PENALTIES = [0.0, 0.00005, 0.0001, 0.0005, 0.001, 0.005, 0.01, 0.05, 0.1, 0.5, 1.0]

# (name, aliases) in matching order: title and summary of feed items
INGEST_ALIASES = [
    ("Arsenal", "Arsenal|Gunners"),
    ("Chelsea", "Chelsea|Blues"),
    ("Manchester United", "Manchester United|Man Utd|Red Devils|Man United"),
    ("Liverpool", "Liverpool|Reds"),
    ("Manchester City", "Manchester City|Man City"),
    ("Tottenham Hotspur", "Tottenham Hotspur|Spurs|Tottenham"),
]

# (name, aliases): keywords that only repeat the team's own name
KEYWORD_ALIASES = [
    ("Arsenal", "Arsenal|Gunners"),
    ("Chelsea", "Chelsea|Blues"),
    ("Liverpool", "Liverpool|Reds"),
    ("Manchester City", "Manchester City|Man City"),
    ("Manchester United", "Manchester United|Man Utd|Red Devils|Man United"),
    ("Tottenham Hotspur", "Tottenham Hotspur|Spurs|Tottenham"),
]

# (name, aliases) in tie-breaking order: full text of the training extract
TRAINING_ALIASES = [
    ("Arsenal", "Arsenal|Gunners|Emirates"),
    ("Chelsea", "Chelsea|Blues|Stamford Bridge"),
    ("Manchester United", "Manchester United|Man Utd|Red Devils|Man United|Old Trafford|United"),
    ("Liverpool", "Liverpool|Reds|Anfield"),
    ("Manchester City", "Manchester City|Man City|Citizens|Etihad|Guardiola|City"),
    ("Tottenham Hotspur", "Tottenham Hotspur|Spurs|Tottenham|White Hart Lane"),
]

STORY_TAGS = ["News Story", "Article/Blog"]
EXCLUDED_BODY_TERM = "WSL"
EXCLUDED_SECTION_HREF = "/sport/football/womens"
EXCLUDED_TRAINING_TERM = "women"
EXCLUDED_TRAINING_MIN = 5
SECONDARY_ENTITY_MIN = 5
TREND_FIRST_DAY = "2025-06-01"

PROMO_LINES = [
    "Sign up to Football Daily",
    "Kick off your evenings with the Guardian's take on the world of football",
    "after newsletter promotion",
]

# Where each outlet keeps byline, standfirst and body. A step is
# (tags, attribute, values); an empty tuple of tags means any tag.
PAGE_SELECTORS = {
    "SkySports": {
        "author": [[((), "class", ("sdc-article-author__name",))]],
        "standfirst": [],
        "body": ((), "class", ("sdc-article-body sdc-article-body--lead",)),
        "every_body": False,
        "blocks": ("p",),
        "children_only": True,
    },
    "BBC": {
        "author": [
            [
                (("div",), "data-component", ("byline-block",)),
                ((), "class", ("ssrcss-12jkbjf-Text-TextContributorName e19uhciu6",)),
            ]
        ],
        "standfirst": [],
        "body": (("div",), "data-component", ("text-block", "subheadline-block")),
        "every_body": True,
        "blocks": ("p", "h2"),
        "children_only": False,
    },
    "TheGuardian": {
        "author": [
            [(("a",), "rel", ("author",))],
            [(("a",), "data-component", ("section",)), (("span",), None, ())],
        ],
        "standfirst": [[(("div",), "data-gu-name", ("standfirst",)), (("p",), None, ())]],
        "body": (
            (),
            "class",
            ("article-body-commercial-selector article-body-viewer-selector dcr-11jq3zt",),
        ),
        "every_body": False,
        "blocks": ("p", "h2"),
        "children_only": False,
    },
}

# ---- end of fixed values ------------------------------------------------------------


def lexicon_rows(aliases: list[tuple[str, str]]) -> list[tuple[int, int, str, str]]:
    """(entity_id, ord, name, pattern) rows of an alias list."""
    return [(TEAM_IDS[name], i + 1, name, pattern) for i, (name, pattern) in enumerate(aliases)]
