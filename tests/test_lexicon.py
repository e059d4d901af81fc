import json

import pytest

from core_helpers import lexicon
from termloom.sources.lexicon import Lexicon, MalformedDocumentError, Metadata, ValidationError, json_schema

ONE = {"preferred": {"singular": "lantern"}}


def entity(**more):
    return {"locales": {"de-DE": ONE}} | more


def base(**change):
    return lexicon(product=entity()) | change


def forms(x):
    return base(entities={"product": {"locales": {"de-DE": x}}})


def movie(**more):
    return base(entities={"movie": entity(**more)})


BAD = [
    ({}, (None, None, "schemaVersion")),
    (base(schemaVersion=1), (None, None, "schemaVersion")),
    (["x"], (None, None, "schemaVersion")),
    (base(extra=1), (None, None, "extra")),
    (base(entities={}), (None, None, "entities")),
    (base(entities=["product"]), (None, None, "entities")),
    ({k: v for k, v in base().items() if k != "defaultLocale"}, (None, None, "defaultLocale")),
    (base(entities={"product": 3}), ("product", None, "entities")),
    (base(entities={"a b": entity()}), (None, None, "entities")),
    (base(entities={"product": {"locales": {}}}), ("product", None, "locales")),
    (base(entities={"product": {"locales": {"german!": ONE}}}), ("product", "german!", "locales")),
    (forms({"preferred": {"plural": "x"}}), ("product", "de-DE", "preferred.singular")),
    (forms({"preferred": {"singular": ""}}), ("product", "de-DE", "preferred.singular")),
    (forms(ONE | {"alternates": ["artikel", ""]}), ("product", "de-DE", "alternates[1]")),
    (forms(ONE | {"alternates": "artikel"}), ("product", "de-DE", "alternates")),
    (forms(ONE | {"synonyms": []}), ("product", "de-DE", "synonyms")),
    (forms(ONE | {"alternates": ["   "]}), ("product", "de-DE", "alternates[0]")),
    (forms({"preferred": {"singular": "x" * 129}}), ("product", "de-DE", "preferred.singular")),
    (forms(ONE | {"alternates": ["ware", "LANTERN"]}), ("product", "de-DE", "alternates[1]")),
    (movie(canonicalId="product type!"), ("movie", None, "canonicalId")),
    (movie(metadata={}), ("movie", None, "metadata")),
    (movie(metadata={"product type": 1}), ("movie", None, "metadata")),
    (movie(metadata={"k" * 65: 1}), ("movie", None, "metadata")),
    (movie(metadata={f"k{i}": 1 for i in range(17)}), ("movie", None, "metadata")),
    (movie(metadata={"t": None}), ("movie", None, "metadata.t")),
    (movie(metadata={"t": {"equals": 1}}), ("movie", None, "metadata.t")),
    (movie(metadata={"t": ""}), ("movie", None, "metadata.t")),
    (movie(metadata={"t": "  "}), ("movie", None, "metadata.t")),
    (movie(metadata={"t": "x" * 129}), ("movie", None, "metadata.t")),
    (movie(metadata={"g": []}), ("movie", None, "metadata.g")),
    (movie(metadata={"g": ["drama", 7]}), ("movie", None, "metadata.g")),
    (movie(metadata={"g": [str(i) for i in range(17)]}), ("movie", None, "metadata.g")),
    (movie(metadata={"g": ["a", "a"]}), ("movie", None, "metadata.g")),
    (base(entities={"product": entity(), "invoice": {"locales": {"de-DE": {"preferred": {"singular": "rechnung"}, "alternates": ["lantern"]}}}}), ("invoice", "de-DE", "alternates[0]")),
    (
        base(entities={"product": entity(), "movie": {"canonicalId": "product", "locales": {"de-DE": {"preferred": {"singular": "film"}}}}, "feature_film": {"canonicalId": "movie", "locales": {"de-DE": {"preferred": {"singular": "spielfilm"}}}}}),
        ("feature_film", None, "canonicalId"),
    ),
]


@pytest.mark.parametrize(("document", "where"), BAD)
def test_faults_and_where_they_are(document, where):
    with pytest.raises(ValidationError) as e:
        Lexicon.from_dict(document)
    assert (e.value.canonical_id, e.value.locale, e.value.field) == where
    assert str(where[2]) in e.value.message


def test_files(tmp_path, spark):
    good, broken, latin = tmp_path / "a.json", tmp_path / "b.json", tmp_path / "c.json"
    good.write_text(json.dumps(base()), "utf-8")
    broken.write_text("{\n oops", "utf-8")
    latin.write_bytes("{\"é\": 1}".encode("latin-1"))
    assert Lexicon.from_file(good).entries == Lexicon.from_path(spark, str(good)).entries
    for path in (broken, latin):
        with pytest.raises(MalformedDocumentError):
            Lexicon.from_file(path)
    with pytest.raises(FileNotFoundError):
        Lexicon.from_file(tmp_path / "none.json")


def test_metadata_is_a_sorted_hashable_mapping():
    m = Metadata({"b": ["x", "y"], "a": 12.0})
    assert list(m) == ["a", "b"] and m["b"] == ("x", "y") and m == {"a": 12.0, "b": ("x", "y")}
    assert hash(m) == hash(Metadata({"a": 12.0, "b": ["x", "y"]})) and m.json() == '{"a":12.0,"b":["x","y"]}'


def test_compiled_forms_keep_the_first_of_equal_folds():
    lex = Lexicon.from_dict(lexicon(cafe={"preferred": {"singular": "café"}, "alternates": ["cafe"]}))
    assert [(f["surface_form"], f["tier"]) for f in lex.forms()] == [("café", "preferred")]


def test_schema_states_the_bounds():
    text = json.dumps(json_schema())
    assert "alternates" in text and json_schema()["properties"]["schemaVersion"] == {"const": "1"}
