"""Shared by the core tests."""


def lexicon(locale="de-DE", default=None, **entries):
    """A document with one entry per keyword: a label, surface forms, or a whole entity."""

    def entity(x):
        if isinstance(x, str):
            x = {"preferred": {"singular": x}}
        return x if "locales" in x else {"locales": {locale: x}}

    return {"schemaVersion": "1", "defaultLocale": default or locale, "entities": {k: entity(v) for k, v in entries.items()}}
