"""The rules as one plan: each enabled rule's text feeds the next, every step is recorded, tokens are counted.

The plan is a chain of projections without a shuffle, so it runs at the speed of the scan on any number of executors,
and on streams as it is. Rules that aren't enabled aren't in it; steps and counts that nobody selects are pruned.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.score import compression_rate
from ..functions.text import is_blank
from ..functions.tokens import Counter, words
from ..operators.rules import BY_ID, RULES, Params, RowParams, Rule, Stage

SKIPPED = "[SKIPPED] Rule is disabled"
FAILED = "[ERROR] Rule failed: "


@dataclass(frozen=True)
class RuleConfig:
    enabled: bool = True
    params: Mapping[str, object] = field(default_factory=dict)


#: What a front end offers at first: everything on, with default parameters.
ALL_ON: dict[str, RuleConfig] = {r.id: RuleConfig() for r in RULES}


def _config(given: RuleConfig | Mapping[str, object] | bool | None) -> RuleConfig:
    if isinstance(given, RuleConfig):
        return given
    if isinstance(given, Mapping):
        return RuleConfig(bool(given.get("enabled", False)), dict(given.get("params") or {}))
    return RuleConfig(bool(given))


#: Columns that optimize() adds; columns of the input by these names give way.
ADDED = ("final_prompt", "steps", "token_stats")


@dataclass
class _Run:
    """The plan as it grows: the text so far, its tokens, and what the rules did."""

    stage: Stage
    counter: Counter
    record: bool
    text: Column
    tokens: Column
    steps: list[Column] = field(default_factory=list)
    savings: list[Column] = field(default_factory=list)

    def _applied(self, rule: Rule, shown: Column, params: Params) -> tuple[Column, Column, Column | None]:
        out, changes, *error = rule.apply(self.stage, shown, params)
        put = self.stage.put
        return put(out), put(changes) if self.record else changes, put(error[0]) if error else None

    def step(self, rule: Rule, ways: list[tuple[Column | None, Params]], enabled: Column | None) -> None:
        """Run the rule on the rows where it is enabled (None: all), each in the first of the ways whose condition it meets.

        A way sees null instead of the texts that don't go it, which costs next to nothing.
        """
        put, text, tokens = self.stage.put, self.text, self.tokens
        done = []
        for condition, params in ways:
            goes = enabled if condition is None else condition if enabled is None else enabled & condition
            shown = text if goes is None else put(F.when(goes, text))
            done.append((goes, *self._applied(rule, shown, params)))
        of = lambda k: [F.when(d[0], d[k]) if d[0] is not None else d[k] for d in done if d[k] is not None]
        errors = of(3)
        error = put(F.coalesce(*errors)) if errors else None
        kept = text if error is None else F.when(error.isNotNull(), text)
        out = put(F.coalesce(*([kept] if error is not None else []), *of(1), text))
        same = rule.id in ("taskAnalyzer", "instructionConflictDetector")
        counted = tokens if same else put(F.when(out == text, tokens).otherwise(self.counter(out)) if self.counter is words else self.counter(out))
        failed = None if self.counter is words or same else counted.isNull()
        if failed is not None:  # the counter gave up on the new text
            out, after = put(F.when(failed, text).otherwise(out)), put(F.coalesce(counted, tokens))
            told = F.coalesce(error, F.when(failed, F.lit("tokens could not be counted"))) if error is not None else F.when(failed, F.lit("tokens could not be counted"))
            error = put(told)
        else:
            after = counted
        changes, status = F.coalesce(*of(2), F.array(F.lit(SKIPPED))), F.lit("done")
        if error is not None:
            changes = F.when(error.isNotNull(), F.array(F.concat(F.lit(FAILED), error))).otherwise(changes)
            status = F.when(error.isNotNull(), F.lit("error")).otherwise(status)
        if enabled is not None:
            changes, status = F.when(enabled, changes).otherwise(F.array(F.lit(SKIPPED))), F.when(enabled, status).otherwise(F.lit("skipped"))
        self.add(rule, out, after, changes, status)

    def add(self, rule: Rule, out: Column, after: Column, changes: Column, status: Column) -> None:
        saved = self.tokens - after
        self.steps.append(
            F.struct(
                F.lit(rule.name).alias("rule_name"), F.lit(rule.level).alias("rule_level"), self.text.alias("input_text"), out.alias("output_text"),
                self.tokens.alias("tokens_before"), after.alias("tokens_after"), saved.alias("tokens_saved"), changes.alias("changes"), status.alias("status"),
            )
        )
        self.savings += [F.lit(rule.name), F.greatest(F.lit(0), saved)]
        self.text, self.tokens = out, after

    def skip(self, rule: Rule) -> None:
        self.add(rule, self.text, self.tokens, F.array(F.lit(SKIPPED)), F.lit("skipped"))


def _started(df: DataFrame, text_col: str, counter: Counter, record: bool) -> _Run:
    stage = Stage(df)
    text = stage.put(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    tokens = stage.put(counter(text) if counter is words else F.coalesce(counter(text), F.lit(0)))
    return _Run(stage, counter, record, text, tokens)


def _ended(run: _Run, names: list[str], first: Column) -> DataFrame:
    stats = F.struct(first.alias("original"), run.tokens.alias("final"), compression_rate(first, run.tokens).alias("compression_rate"), F.create_map(*run.savings).alias("by_rule"))
    added = {"final_prompt": run.text, **({"steps": F.array(*run.steps)} if run.record else {}), "token_stats": stats}
    own = [n for n in names if n.lower() not in added]
    return run.stage.df.select(*(F.col(f"`{n}`") for n in own), *(c.alias(n) for n, c in added.items()))


def _chosen(order: tuple[str, ...] | None, extra: tuple[Rule, ...]) -> tuple[tuple[Rule, ...], dict[str, Rule]]:
    known = BY_ID | {r.id: r for r in extra}
    return ((*RULES, *extra) if order is None else tuple(known[i] for i in order)), known


def optimize(
    df: DataFrame, rules: Mapping[str, RuleConfig | Mapping[str, object] | bool] | None = None, text_col: str = "text", counter: Counter = words, order: tuple[str, ...] | None = None, record: bool = True, extra: tuple[Rule, ...] = ()
) -> DataFrame:
    """df with final_prompt, steps and token_stats; columns of df by these names give way.

    rules: by rule id; a rule that is missing or not enabled is skipped, so None skips all. order: other rules in
    another order than the registry's. extra: rules of the caller's, behind the others. record: False leaves out steps,
    for a smaller plan. Null texts count as empty. steps has a struct for each rule, in order: rule_name, rule_level,
    input_text, output_text, tokens_before, tokens_after, tokens_saved (may be negative), changes, status ("done",
    "skipped" or "error"). The fifteen rules are total and can't fail; one of the caller's (operators.custom) may, and so
    may the caller's counter: the step then keeps the text, its record tells why, and the next rule goes on. token_stats:
    original, final, compression_rate in percent, by_rule (savings by rule name, not below 0).
    """
    chosen, known = _chosen(order, extra)
    unknown = set(rules or {}) - set(known)
    if unknown:
        raise ValueError(f"unknown rules: {sorted(unknown)}")
    run = _started(df, text_col, counter, record)
    first = run.tokens
    for rule in chosen:
        config = _config((rules or {}).get(rule.id))
        if config.enabled:
            run.step(rule, [(None, Params(dict(config.params)))], None)
        else:
            run.skip(rule)
    return _ended(run, df.columns, first)


def optimize_requests(df: DataFrame, prompt_col: str = "prompt", rules_col: str = "rules", counter: Counter = words, order: tuple[str, ...] | None = None, record: bool = True) -> DataFrame:
    """Like optimize(), each row by the rules that it brings: a map from rule id to enabled and params (strings).

    One plan serves all rows, however many different configurations there are: a rule's parameters are columns, and a
    rule whose phrases hang on a parameter is planned once for each of its tiers. Rows pass by the rules that they don't
    enable. Nothing is collected, and no row is moved. A null map or entry, and ids that no rule has, enable nothing;
    parameters that can't be read take their defaults. rules_col has the type of sources.io.requests.
    """
    run = _started(df, prompt_col, counter, record)
    first = run.tokens
    for rule in _chosen(order, ())[0]:
        entry = F.element_at(F.col(f"`{rules_col}`"), F.lit(rule.id))
        enabled = run.stage.put(F.coalesce(entry["enabled"], F.lit(False)))
        params = run.stage.put(F.coalesce(entry["params"], F.create_map().cast("map<string,string>")))
        run.step(rule, rule.variants(RowParams(column=params)), enabled)
    return _ended(run, df.columns, first)


def blank(text_col: str) -> Column:
    """Whether a request's text is rejected: null or blank."""
    return F.col(f"`{text_col}`").isNull() | is_blank(F.col(f"`{text_col}`"))


def reject_blank(df: DataFrame, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows to work on, rows whose text is null or blank)."""
    return df.where(~blank(text_col)), df.where(blank(text_col))


def rules_table(spark: SparkSession) -> DataFrame:
    """id, name, level, description, position of every rule."""
    return spark.createDataFrame([(r.id, r.name, r.level, r.description, k) for k, r in enumerate(RULES)], "id string, name string, level string, description string, position int")
