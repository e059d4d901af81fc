"""The lexicons of the catalogue's queries: of a shop's parts, of frequent words in four languages, of events."""

from __future__ import annotations


def _forms(singular: str, *alternates: str, plural: str | None = None) -> dict:
    preferred = {"singular": singular} | ({"plural": plural} if plural else {})
    return {"preferred": preferred} | ({"alternates": list(alternates)} if alternates else {})


SHOP = {
    "schemaVersion": "1",
    "defaultLocale": "en",
    "entities": {
        "widget": {"locales": {"en": _forms("widget", "gadget", plural="widgets"), "de-DE": _forms("apparat")}},
        "red-widget": {"canonicalId": "widget", "metadata": {"colour": "red", "premium": True}, "locales": {"en": _forms("red widget")}},
        "old-widget": {"canonicalId": "widget", "metadata": {"state": ["old", "used"], "rank": 2}, "locales": {"en": _forms("old widget")}},
        "bolt": {"locales": {"en": _forms("bolt", plural="bolts"), "de-DE": _forms("bolt", "bolzen"), "de-AT": _forms("schraube", "plate")}},
        "small-bolt": {"canonicalId": "bolt", "metadata": {"size": 1.5}, "locales": {"en": _forms("small bolt", "tiny bolt")}},
        "gizmo": {"locales": {"en": _forms("gizmo"), "fr-FR": _forms("gizmo", "machin")}},
        "plating": {"locales": {"en": _forms("plate", "large plate")}},
        "anvil": {"locales": {"en": _forms("anvils", "anvil")}},
        "cold": {"locales": {"en": _forms("cold")}},
    },
}

TALK = {
    "schemaVersion": "1",
    "defaultLocale": "en",
    "entities": {
        "article": {"locales": {"en": _forms("the", "a", "an"), "de": _forms("der", "die", "das"), "fr": _forms("le", "la", "les"), "es": _forms("el", "los", "las")}},
        "and": {"canonicalId": "conjunction", "locales": {"en": _forms("and"), "de": _forms("und"), "fr": _forms("et"), "es": _forms("y")}},
        "origin": {"canonicalId": "preposition", "metadata": {"case": "genitive"}, "locales": {"en": _forms("of", "from"), "de": _forms("von"), "fr": _forms("de", "des"), "es": _forms("del")}},
        "company": {"canonicalId": "preposition", "locales": {"en": _forms("with"), "de": _forms("mit"), "fr": _forms("avec"), "es": _forms("con")}},
        "negation": {"locales": {"de": _forms("nicht"), "fr": _forms("dans")}},
        "likely": {"locales": {"en": _forms("thereon", "tionable")}},
    },
}

EVENTS = {
    "schemaVersion": "1",
    "defaultLocale": "en",
    "entities": {
        "conversion": {"locales": {"en": _forms("purchase", "signup")}},
        "visit": {"locales": {"en": _forms("view", "click", plural="views")}},
        "failure": {"locales": {"en": _forms("errors")}},
    },
}

ODD = {
    "schemaVersion": "1",
    "defaultLocale": "en",
    "entities": {
        "language": {"locales": {"en": _forms("c++", "f#"), "ar-EG": _forms("لغة")}},
        "arrow": {"locales": {"en": _forms("=>")}},
        "coffee": {"locales": {"en": _forms("café", "crème brûlée"), "ar-EG": _forms("قهوة")}},
        "north": {"locales": {"en": _forms("north sea oil")}},
        "oil": {"locales": {"en": _forms("oil rig west")}},
        "west": {"locales": {"en": _forms("west wing")}},
        "wing": {"locales": {"en": _forms("wing mirror glass", "straße")}},
    },
}

#: Before a part's name, by turns: chains of overlaps, punctuation, accents apart from and in their letters, Arabic.
ODD_PROMPTS = (
    "north sea oil rig west wing mirror glass", "c++ c++x xc++ c++_ f#, =>c++=>", "cafe\u0301 CAFÉ cafés crème bru\u0302lée", "شرب قهوة و لغة",
    "½ STRASSE Straße straßen", "oil rig west wing mirror", "الــقهوة قهوة، لغةc++", "west wing-mirror glass north sea oil", "=> north sea",
)
