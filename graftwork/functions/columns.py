"""Column builders: naming, labels, predicates. All stay inside codegen."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from graftwork.functions.fixed import DATA_PREFIX, FINAL_CHECKPOINT, TASK_LABELS


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_not(c: str | Column, value) -> Column:
    """``c != value`` where a null counts as different (never null itself)."""
    return ~col(c).eqNullSafe(F.lit(value))


def basename(path: str | Column) -> Column:
    """Last path segment, ignoring trailing slashes."""
    return F.regexp_extract(F.regexp_replace(col(path), "/+$", ""), "([^/]*)$", 1)


def task_of(dataset: str | Column) -> Column:
    """Task slug of a dataset path: every literal prefix occurrence removed."""
    return F.replace(col(dataset), F.lit(DATA_PREFIX), F.lit(""))


def parse_lr(name: str | Column) -> Column:
    """Learning rate written into a directory name as ``_lr<number>``, else null."""
    digits = F.regexp_extract(col(name), r"_lr([\d.eE\-]+)", 1)
    return F.when(digits != "", digits).cast("double")


def checkpoint_step(path: str | Column) -> Column:
    """Step of a directory named exactly ``checkpoint-<int>``, else null."""
    digits = F.regexp_extract(basename(path), r"^checkpoint-(\d+)$", 1)
    return F.when(digits != "", digits).cast("bigint")


def glob_to_regex(pattern: str, paths: bool = False) -> str:
    """Anchored regex for a shell glob (``*``, ``?``, ``[...]``, ``[!...]``).

    With ``paths``, ``*`` and ``?`` stop at a slash.
    """
    any_sign = "[^/]" if paths else "."
    out, i = [], 0
    while i < len(pattern):
        ch = pattern[i]
        close = pattern.find("]", i + 2) if ch == "[" else -1
        if ch == "*":
            out.append(any_sign + "*")
        elif ch == "?":
            out.append(any_sign)
        elif close > 0:
            body = pattern[i + 1 : close].replace("\\", "\\\\").replace("[", "\\[")
            out.append("[^" + body[1:] + "]" if body[0] == "!" else "[" + body + "]")
            i = close
        else:
            out.append(re.sub(r"([.^$*+?{}\[\]\\|()])", r"\\\1", ch))
        i += 1
    return "(?s)^" + "".join(out) + "$"


def matches_any(name: str | Column, patterns: Sequence[str], paths: bool = False) -> Column:
    """True if the name matches at least one glob; one regex, evaluated once."""
    if not patterns:
        return F.lit(False)
    return col(name).rlike("|".join(f"(?:{glob_to_regex(p, paths)})" for p in patterns))


def glob_filter(
    name: str | Column, include: str | Sequence[str], exclude: str | Sequence[str] | None = None
) -> Column:
    """Included by a glob and not excluded by another."""
    as_list = lambda p: [p] if isinstance(p, str) else list(p or [])
    keep = matches_any(name, as_list(include))
    return keep & ~matches_any(name, as_list(exclude)) if exclude else keep


def is_self_eval(dataset: str | Column, model: str | Column) -> Column:
    """Dataset basename occurs inside the model basename."""
    return basename(F.coalesce(col(model), F.lit(""))).contains(
        basename(F.coalesce(col(dataset), F.lit("")))
    )


def is_intermediate(checkpoint: str | Column) -> Column:
    """Everything but the final checkpoint; a null checkpoint is not final."""
    return is_not(checkpoint, FINAL_CHECKPOINT)


def pct(c: str | Column) -> Column:
    return col(c) * F.lit(100.0)


def template(pattern: str | Column, variables: Mapping[str, str | Column]) -> Column:
    """Fill ``{name}`` placeholders of a string column.

    Use :func:`typed_template` when the whole value is one placeholder and the
    variable's own type has to survive.
    """
    out = F.lit(pattern) if isinstance(pattern, str) else pattern
    for name, value in variables.items():
        out = F.replace(out, F.lit("{" + name + "}"), col(value).cast("string"))
    return out


def typed_template(pattern: str, variables: Mapping[str, str | Column]) -> Column:
    """Like :func:`template`, but a lone ``{name}`` keeps the variable's type."""
    for name, value in variables.items():
        if pattern == "{" + name + "}":
            return col(value)
    return template(pattern, variables)


def _lookup(pairs: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def task_label(task: str | Column, labels: Mapping[str, str] | None = None) -> Column:
    """Configured label, else a known one, else title case cut to eight characters."""
    t = col(task)
    title = F.initcap(F.replace(t, F.lit("_"), F.lit(" ")))
    auto = F.when(F.length(title) > 8, F.concat(F.substring(title, 1, 8), F.lit("."))).otherwise(
        title
    )
    known = F.try_element_at(_lookup(TASK_LABELS), t)
    if labels:
        return F.coalesce(F.try_element_at(_lookup(labels), t), known, auto)
    return F.coalesce(known, auto)


def lr_label(lr: str | Column) -> Column:
    """``5e-5``-style label: two-decimal mantissa with trailing zeros dropped."""
    sci = F.format_string("%.2e", col(lr))
    mantissa = F.regexp_replace(F.regexp_extract(sci, r"^(-?[\d.]+)e", 1), r"\.?0*$", "")
    exponent = F.regexp_extract(sci, r"e([+-]\d+)$", 1).cast("int").cast("string")
    return F.concat(mantissa, F.lit("e"), exponent)


def duration_label(seconds: str | Column) -> Column:
    """``12.3s``, ``4m 05s`` or ``2h 03m 09s``."""
    s = col(seconds).cast("double")
    whole = F.floor(s)
    m, sec = F.floor(whole / 60), F.pmod(whole, F.lit(60))
    return (
        F.when(s < 60, F.format_string("%.1fs", s))
        .when(m < 60, F.format_string("%dm %02ds", m, sec))
        .otherwise(F.format_string("%dh %02dm %02ds", F.floor(m / 60), F.pmod(m, F.lit(60)), sec))
    )


# --- report cells -----------------------------------------------------------
MISSING_CELL = "---"


def fmt_val(mean, std, n_seeds) -> Column:
    """``mean ± std``; the deviation only shows with several seeds and std > 0."""
    m, s, n = col(mean), col(std), col(n_seeds)
    plain = F.format_string("%.1f", m)
    return F.when((s > 0) & (n > 1), F.concat(plain, F.lit(" ± "), F.format_string("%.1f", s))).otherwise(
        plain
    )


def fmt_time(value) -> Column:
    v = col(value)
    return F.when(v.isNull(), MISSING_CELL).otherwise(F.format_string("%.0f", v))


def fmt_pct(value) -> Column:
    v = col(value)
    return F.when(v.isNull(), MISSING_CELL).otherwise(F.format_string("%.0f%%", v * 100))


def fmt_speedup(mean, std, n_seeds) -> Column:
    """A clean zero prints as ``0``; a missing mean prints as dashes."""
    m, s, n = col(mean), F.coalesce(col(std), F.lit(0.0)), col(n_seeds)
    base = F.when((m == 0) & (s == 0), "0").otherwise(F.format_string("%.1f", m))
    full = F.when((s > 0) & (n > 1), F.concat(base, F.lit(" ± "), F.format_string("%.1f", s)))
    return F.when(m.isNull(), MISSING_CELL).otherwise(F.coalesce(full, base))
