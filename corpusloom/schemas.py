"""Constants of the document and graph contracts."""

from __future__ import annotations

#: Chunk sizes in approximate tokens.
TARGET_TOKENS, MOST_TOKENS, SMALL_TOKENS = 400, 800, 50
CHUNK_TYPES = ("text", "table", "infobox")
#: Fixed value: words in the smallest number of words with TARGET_TOKENS tokens.
WORDS_PER_PIECE = 308
#: Lines that head a section.
SECTION_NAMES = (
    "early life", "early life and career", "early life and education", "career", "personal life", "education", "history", "background", "legacy", "reception", "critical reception", "critical response", "accolades", "awards",
    "filmography", "discography", "bibliography", "references", "see also", "external links", "plot", "cast", "production", "development", "writing", "new writers", "casting", "filming", "post-production", "soundtrack", "release",
    "box office", "home media", "television premiere", "marketing", "sequel", "sequels", "music", "impact", "franchise", "theatrical", "re-releases", "effects", "design", "summary", "qualification", "qualifications",
    "competition format", "schedule", "records", "results", "results table", "heats", "semifinals", "quarterfinals", "final", "finals", "qualifying", "qualifying round", "repechage", "reserves", "political career",
    "political positions", "tenure", "committee assignments", "operations", "products and services", "management", "financial information", "corporate affairs", "controversies",
)
#: Entity types, and the types that each relation joins.
ENTITY_TYPES = ("Document", "OlympicGames", "Event", "Athlete", "Country", "Venue", "Sport")
RELATIONS = {
    "PART_OF": ("Event", "OlympicGames"),
    "SUB_EVENT_OF": ("Event", "Event"),
    "AT_VENUE": ("Event", "Venue"),
    "IN_SPORT": ("Event", "Sport"),
    "WON_BY": ("Event", "Athlete"),
    "REPRESENTS": ("Athlete", "Country"),
    "PARTICIPATED_IN": ("Athlete", "Event"),
}
MEDALS = ("GOLD", "SILVER", "BRONZE")
#: Labels of entity recognition, and their types.
LABELS = {
    "athlete": "Athlete", "person": "Athlete",
    "country": "Country", "nation": "Country",
    "venue": "Venue", "stadium": "Venue", "arena": "Venue", "gymnasium": "Venue", "oval": "Venue",
    "sport": "Sport", "discipline": "Sport",
    "event": "Event", "competition": "Event",
    "olympic games": "OlympicGames", "olympics": "OlympicGames",
}
