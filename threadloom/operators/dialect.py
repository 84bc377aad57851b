"""One SQL text for two engines: the operators' bodies, with the few words in which they differ.

``@name(args)`` stands for an expression that each engine spells in its own way, ``{table}`` for
one of the canonical tables.
"""

from __future__ import annotations

import re

#: name -> (Spark, other engine); arguments are $1, $2, ...
WORDS = {
    # rounded away from ties, on which sums in another order would differ
    "r6": ("cast(round($1 + 1e-10, 6) + 0.0 as double)", "cast(round($1 + 1e-10, 6) + 0.0 as double)"),
    "r4": ("cast(round($1 + 1e-9, 4) + 0.0 as double)", "cast(round($1 + 1e-9, 4) + 0.0 as double)"),
    "corr": ("(covar_pop($1, $2) / nullif(stddev_pop($1) * stddev_pop($2), 0.0))", "(covar_pop($1, $2) / nullif(stddev_pop($1) * stddev_pop($2), 0.0))"),
    "n": ("cast($1 as bigint)", "cast($1 as bigint)"),
    "f": ("cast($1 as double)", "cast($1 as double)"),
    "div": ("(($1) div ($2))", "(($1) // ($2))"),
    "re": ("r$1", "$1"),
    "percentile": ("percentile($1, $2)", "quantile_cont($1, $2)"),
    "matches": ("($1 rlike $2)", "regexp_matches($1, $2)"),
    "replace": ("regexp_replace($1, $2, $3)", "regexp_replace($1, $2, $3, 'g')"),
    "all": ("regexp_extract_all($1, $2, 0)", "regexp_extract_all($1, $2)"),
    "size": ("greatest(size($1), 0)", "len($1)"),
    "explode": ("explode($1)", "unnest($1)"),
    # a handle like Word12 between white space and its end; without look-around two passes are needed, as neighbours share a space
    "handles": (
        r"""regexp_replace($1, r'(?<=\s)[A-Z][a-zA-Z]{2,}[0-9]{1,4}(?=[\s.,;:!?)"]|$)', '[MENTION]')""",
        r"""regexp_replace(regexp_replace($1, '(\s)[A-Z][a-zA-Z]{2,}[0-9]{1,4}([\s.,;:!?)"]|$)', '\1[MENTION]\2', 'g'), '(\s)[A-Z][a-zA-Z]{2,}[0-9]{1,4}([\s.,;:!?)"]|$)', '\1[MENTION]\2', 'g')""",
    ),
    "iso": ("date_format($1, 'yyyy-MM-dd HH:mm:ss')", "strftime($1, '%Y-%m-%d %H:%M:%S')"),
    "sha": ("sha2($1, 256)", "sha256($1)"),
    "epoch": ("(unix_micros(cast($1 as timestamp)) / 1e6D)", "(epoch_us($1) / 1e6)"),
    "draw": ("cast(conv(substr(md5($1), 1, 7), 16, 10) as bigint)", "('0x' || substr(md5($1), 1, 7))::bigint"),
    "list": ("collect_list($1)", "list($1)"),
    "join_sorted": ("array_join(array_sort(collect_set($1)), $2)", "array_to_string(list_sort(list(distinct $1)), $2)"),
    "split": ("split($1, $2)", "regexp_split_to_array($1, $2)"),
    "filter_nonempty": ("filter(transform($1, x -> trim(x)), x -> x <> '')", "list_filter(list_transform($1, lambda x: trim(x)), lambda x: x <> '')"),
    "contains": ("contains($1, $2)", "contains($1, $2)"),
    "json": ("get_json_object($1, $2)", "json_extract_string($1, $2)"),
    "range": ("sequence($1, $2)", "range($1, $2 + 1)"),
    "char": ("char($1)", "chr($1)"),
    "first_chars": ("substring($1, 1, $2)", "substr($1, 1, $2)"),
    "get": ("get($1, $2)", "$1[$2 + 1]"),
    "floor": ("cast(floor($1) as bigint)", "cast(floor($1) as bigint)"),
    "int": ("cast($1 as int)", "cast($1 as int)"),
    "any": ("bool_or($1)", "bool_or($1)"),
    "fixed": ("format_string($1, $2)", "printf($1, $2)"),
    "fixed2": ("format_string($1, $2, $3)", "printf($1, $2, $3)"),
}


def _arguments(text: str, at: int) -> tuple[list[str], int]:
    """Arguments of the call whose bracket opens at ``at``, and where it ends."""
    depth, quoted, start, out = 0, False, at + 1, []
    for i in range(at, len(text)):
        c = text[i]
        if c == "'":
            quoted = not quoted
        elif quoted:
            continue
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
            if depth == 0:
                return [*out, text[start:i].strip()], i + 1
        elif c == "," and depth == 1:
            out.append(text[start:i].strip())
            start = i + 1
    raise ValueError("unbalanced call in operator text")


def expand(text: str, spark: bool) -> str:
    """The body as one engine reads it."""
    while m := re.search(r"@(\w+)\(", text):
        args, end = _arguments(text, m.end() - 1)
        form = WORDS[m[1]][0 if spark else 1]
        for i in range(len(args), 0, -1):
            form = form.replace(f"${i}", args[i - 1])
        text = text[: m.start()] + form + text[end:]
    if spark:  # numbers with a point are doubles there only if they say so
        parts = text.split("'")
        parts[::2] = [re.sub(r"(?<![\w.])(\d+\.\d+)(?![\w.])", r"\1D", p) for p in parts[::2]]
        text = "'".join(parts)
    return text
