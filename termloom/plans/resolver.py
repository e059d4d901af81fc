"""The resolver: prompts in a DataFrame, a match report per row."""

from __future__ import annotations

from pathlib import Path

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import termloom
from termloom.functions.canonical import MATCH, REPORT
from termloom.functions.folding import strips, tokens
from termloom.functions.reports import MatchReport, from_row
from termloom.operators.chain import chain_key, chains
from termloom.operators.exact import exact_hits
from termloom.operators.guards import is_blank, rejection, too_long
from termloom.operators.names import free_name
from termloom.operators.onepass import Compiled, resolved
from termloom.sources.lexicon import MAX_PROMPT_LENGTH, Lexicon, ValidationError

# Executors may not have this package on their path; its functions travel with the plan.
cloudpickle.register_pickle_by_value(termloom)

#: Rows of compiled forms, some hundred bytes each, up to which they are broadcast.
MOST_BROADCAST = 20_000
FIELDS = ("canonical_id", "entry_id", "surface_form", "span_start", "span_end", "score_tier", "matched_locale", "correction", "metadata")
FORM_COLUMNS = (
    "f_chain string, pos int, f_strip boolean, form_id int, locale string, folded string, form_len int, anchor string, anchor_off int, "
    "wordless boolean, plain boolean, spaced boolean, budget int, entry_id string, canonical_id string, surface_form string, "
    "tier string, tier_rank int, metadata string"
)


class EntityResolver:
    """A lexicon, compiled once, and the plans that resolve prompts with it."""

    def __init__(self, lexicon: Lexicon, *, fuzzy: bool = True, fallback_chain=None):
        self.lexicon, self.fuzzy = lexicon, fuzzy
        self.chains = chains(lexicon, fallback_chain)
        self.forms = lexicon.forms()
        by_locale: dict[str, list] = {}
        for f in self.forms:
            by_locale.setdefault(f["locale"], []).append(f)
        self.rows = [
            (key, pos, strips(tag), f["form_id"], *(v for k, v in f.items() if k != "form_id"))
            for key, chain in self.chains.items() for pos, tag in enumerate(chain) for f in by_locale.get(tag, [])
        ]
        self.wordless = tuple(sorted({f["folded"] for f in self.forms if f["wordless"]}))
        self.reach = max((f["form_len"] for f in self.forms if not f["plain"] and not f["wordless"]), default=0)
        self.compiled = Compiled(self.forms, self.chains, fuzzy)
        self.scripts = {key: sorted({strips(tag) for tag in chain}) for key, chain in self.chains.items()}

    @classmethod
    def from_file(cls, path: str | Path, **options) -> EntityResolver:
        return cls(Lexicon.from_file(path), **options)

    @classmethod
    def from_dict(cls, document, **options) -> EntityResolver:
        return cls(Lexicon.from_dict(document), **options)

    def forms_table(self, spark: SparkSession) -> DataFrame:
        """One row per form and chain that leads to it."""
        return spark.createDataFrame(self.rows, FORM_COLUMNS)

    def words(self, texts: DataFrame) -> DataFrame:
        """texts (key, prompt, chain) as one row per word and way of folding."""
        scripts = F.create_map(*(x for k, v in self.scripts.items() for x in (F.lit(k), F.array(*(F.lit(s) for s in v)).cast("array<boolean>"))))
        folded = texts.withColumn("strip", F.explode(F.element_at(scripts, F.col("chain"))))
        found = tokens(F.col("prompt"), F.col("strip"), self.wordless, self.reach)
        return folded.select("key", "chain", "strip", F.explode(found).alias("w")).select("key", "chain", "strip", "w.*")

    def hits(self, texts: DataFrame) -> DataFrame:
        """All places in texts (key, prompt, chain) where forms stand, those that lose against others too: key, pos,
        form_id and spans. Words meet the forms' anchors in a join; it is a broadcast where forms are few."""
        return exact_hits(self.words(texts), self.small(self.forms_table(texts.sparkSession)))

    def small(self, forms: DataFrame) -> DataFrame:
        """`forms`, with a broadcast hint if the lexicon, which the driver holds, is small."""
        return F.broadcast(forms) if len(self.rows) <= MOST_BROADCAST else forms

    def matches(self, df: DataFrame, prompt="prompt", locale="locale") -> DataFrame:
        """`df` exploded to one row per match: its columns, then match_no and the fields of a match. A field whose name
        the table has gets an underscore in front."""
        report = free_name(df.columns, "report")
        out = self.transform(df, prompt, locale, report).where(F.size(F.col(report)["matches"]) > 0)
        n, m = free_name(df.columns, "match_no"), free_name([*df.columns, report], "match")
        mine = [F.col(f"`{c}`") for c in df.columns]
        out = out.select(*mine, F.posexplode(F.col(report)["matches"]).alias(n, m))
        return out.select(*mine, n, *(F.col(m)[c].alias(free_name(df.columns, c)) for c in FIELDS))

    def transform(self, df: DataFrame | str, prompt="prompt", locale="locale", report="report", on_error: str = "column") -> DataFrame | MatchReport:
        """`df` with a column `report`; with a text and its locale instead, that text's report, found in this process.

        A null prompt has a null report. A prompt that is too long, or one without a locale, is rejected: its report has
        an error and no matches (`on_error="column"`), or the query fails (`"raise"`). A report depends on its row alone,
        so each prompt is read where it lies, in one Arrow function over the compiled lexicon, which travels with the
        plan: no row is moved, and rows that repeat cost nothing but themselves.
        """
        if not isinstance(df, DataFrame):
            return from_row(self.report_of(df, prompt))
        p, loc = F.col(f"`{prompt}`"), F.col(f"`{locale}`")
        error = rejection(p, loc)
        fits = p.isNotNull() & loc.isNotNull() & error.isNull() & ~is_blank(p)
        held = free_name([*df.columns, report], "answer")
        df, answer = df.withColumn(held, resolved(self.compiled, F.when(fits, p), F.when(fits, chain_key(loc, self.chains)))), F.col(held)
        nothing = F.expr(f"cast(array() as array<{MATCH}>)")
        matches = F.coalesce(answer["matches"], nothing)
        if on_error == "raise":
            matches = F.when(error.isNotNull(), F.raise_error(error["message"]).cast(f"array<{MATCH}>")).otherwise(matches)
        made = F.struct(p.alias("prompt"), F.coalesce(answer["locale"], loc).alias("locale"), matches.alias("matches"), error.alias("error"))
        return df.withColumn(report, F.when(p.isNotNull(), made).cast(REPORT)).drop(held)

    def report_of(self, prompt: str, locale: str) -> dict:
        """One prompt's report as a table has it; rejected prompts raise."""
        for name, value in (("prompt", prompt), ("locale", locale)):
            if not isinstance(value, str):
                raise ValidationError(f"Field {name!r} is missing." if value is None else f"Field {name!r} is no text.", field=name)
        if len(prompt) > MAX_PROMPT_LENGTH:
            raise ValidationError(too_long(len(prompt)), field="prompt")
        for i, c in enumerate(prompt if not prompt.isascii() else ""):
            if "\ud800" <= c <= "\udfff":
                raise ValidationError(f"Field 'prompt' has the lone surrogate U+{ord(c):04X} at {i}.", field="prompt")
        found = self.compiled.resolve(prompt, self.compiled.key(locale)) if prompt.strip() else []
        matches = []
        for form, a, z, fuzzy in found:
            f = self.forms[form]
            matches.append({
                "canonical_id": f["canonical_id"], "entry_id": f["entry_id"], "surface_form": f["surface_form"], "span_start": a, "span_end": z,
                "score_tier": f["tier"], "matched_locale": f["locale"], "correction": prompt[a:z] if fuzzy else None, "metadata": f["metadata"],
            })
        return {"prompt": prompt, "locale": matches[0]["matched_locale"] if matches else locale, "matches": matches, "error": None}
