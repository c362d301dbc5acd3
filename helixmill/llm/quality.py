"""Quality rules, line first (operator 2). DataFrame functions only: no shuffle, no Python.

Every line is judged by punctuation, navigation and boilerplate rules; failing lines go; a document that loses
more than MAX_LOSS percent of its word characters, or fails the base rules, is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

MIN_WORDS, MAX_REPEAT_PERCENT, MAX_LOSS = 50, 50, 30
#: A line fails as boilerplate if it holds one of these, lower-cased; or, in any language, by its form: a copyright sign, more
#: than two digits in three word characters, or an address among fewer words than ADDRESS_LINE.
BOILERPLATE = (
    *("all rights reserved", "click here", "cookie policy", "enable javascript", "lorem ipsum", "privacy policy", "sign up for our newsletter", "terms of service", "terms of use"),
    *("alle rechte vorbehalten", "datenschutzerklärung", "nutzungsbedingungen"),
    *("tous droits réservés", "politique de confidentialité", "mentions légales"),
    *("todos los derechos reservados", "política de privacidad", "aviso legal"),
)
ADDRESS_LINE = 8
#: A line of fewer words needs a terminal mark.
SHORT_LINE = 5
_BLANKS, _SPACES = "\t\n\x0b\x0c\r", "     "
_SYMBOLS, _DIGITS, _ADDRESS = "#*$%&|<>", "0123456789", ("://", "www.")


def words_of(text: Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of text as an array; of null, an empty one."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _BLANKS, _SPACES), " ", -1), "")


def _count(line: str, chars: str) -> str:
    return f"(length({line}) - length(translate({line}, '{chars}', '')))"


def _addressed(line: str) -> str:
    return " or ".join(f"contains({line}, '{a}')" for a in _ADDRESS)


#: SQL: whether any of the phrases is in the lower-cased text `low`.
_PHRASES = " or ".join(f"contains(low, '{p}')" for p in BOILERPLATE)


def _fails(line: str) -> str:
    """SQL: whether a line fails.
    Navigation: separators | > » • are a fifth of its words or more, or it is a short line without a terminal
    mark. Punctuation: symbols are a tenth of its word characters or more, or a doubled exclamation mark comes
    with every third word or more. Boilerplate: one of the phrases or forms, or a line of code braces.
    What a whole text lacks (__s symbols, __b phrases, __f forms) isn't looked for in its lines."""
    odd = " or ".join(f"contains({line}, '{c}')" for c in ("\\t", "\\u000b", "\\f", "\\r"))
    plain = f"if({odd}, translate({line}, '\\t\\u000b\\f\\r', '    '), {line})"
    words = "greatest(size(filter(v.w, w -> w <> '')), 1)"
    separators = "size(filter(v.w, w -> w in ('|', '>', '»', '•')))"
    bangs = f"((length({line}) - length(replace({line}, '!!', ''))) / 2)"
    chars = f"(length({line}) - size(v.w) + 1)"  # the words are cut at each blank
    rules = (
        f"((size(v.w) < {SHORT_LINE} or array_contains(v.w, '')) and {words} < {SHORT_LINE} and not rtrim(array_join(v.w, ' ')) rlike '[.!?:;\"”…]$')"
        f" or ((__s > 0 or contains({line}, '»') or contains({line}, '•')) and {separators} > 0 and 5 * {separators} >= {words})"
        f" or (__s > 0 and 10 * {_count(line, _SYMBOLS)} >= {chars})"
        f" or (contains({line}, '!!') and 3 * {bangs} >= {words})"
        f" or (__b and exists(array(lower({line})), low -> {_PHRASES}))"
        f" or (__f.sign and contains({line}, '©')) or (__f.digits and 3 * {_count(line, _DIGITS)} > 2 * {chars})"
        f" or (__f.address and {words} < {ADDRESS_LINE} and ({_addressed(line)}))"
        f" or ((contains({line}, '{{') or contains({line}, '}}')) and {_count(line, '{}')} > 1)"
    )
    # v: the line's words, cut once
    return f"exists(array(struct(split({plain}, ' ', -1) as w)), v -> {rules})"


#: Words in 3-word windows that occur twice or more. __h: 64-bit hashes of the windows, in order. Sorted with their
#: places, equal ones meet; the places that have an equal, in order, cover 3 words each less what they share.
_REPEATS = """case when size(__h) = size(array_distinct(__h)) then 0L else
transform(array(sort_array(transform(__h, (x, i) -> struct(x as k, i as i)))), s ->
  transform(array(sort_array(transform(filter(s, (e, j) -> get(s, j - 1).k <=> e.k or get(s, j + 1).k <=> e.k), e -> e.i))), p ->
    aggregate(transform(p, (x, j) -> if(j = 0, 3L, least(3L, cast(x - get(p, j - 1) as bigint)))), 0L, (a, x) -> a + x))[0])[0] end"""


def measured(docs: DataFrame) -> DataFrame:
    """docs with one column __q: a struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept and text (the lines that pass, joined). A null text has no words and no text. The windows are compared
    by 64-bit hashes within one document: at 100,000 words the chance of a false repeat is below 1e-9."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.withColumn("__w", words_of(F.col("text"))).withColumn("__l", F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, _BLANKS + " ", "")) > 0))
    symbols = (F.length(text) - F.length(F.translate(text, _SYMBOLS, ""))).cast("long")
    forms = f"struct(contains(text, '©') as sign, {_addressed('text')} as address, text rlike '[0-9]' as digits)"
    d = d.withColumns({"__s": symbols, "__b": F.expr(_PHRASES.replace("low,", "lower(text),")), "__f": F.expr(forms)})
    hashes = F.expr("if(size(__w) >= 3, transform(sequence(0, size(__w) - 3), i -> xxhash64(__w[i], __w[i + 1], __w[i + 2])), cast(array() as array<bigint>))")
    d = d.select(
        *docs.columns,
        F.size("__w").cast("long").alias("__n"),
        hashes.alias("__h"),
        F.length(F.translate(text, _BLANKS + " ", "")).cast("long").alias("__c"),
        "__s",
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("__d"),
        F.expr(f"filter(__l, x -> not ({_fails('x')}))").alias("__k"),
        (F.size("__l") > 0).alias("__any"),
    )
    d = d.withColumn("__r", F.expr(_REPEATS))
    failed = (F.col("__n") < MIN_WORDS) | (100 * F.col("__r") > MAX_REPEAT_PERCENT * F.col("__n"))
    clean = F.array_join("__k", "\n")
    left = F.length(F.translate(clean, _BLANKS + " ", ""))
    kept = ~failed & (100 * left >= (100 - MAX_LOSS) * F.col("__c"))
    q = F.struct(F.col("__n").alias("n_words"), F.col("__c").alias("word_chars"), F.col("__s").alias("n_symbols"), F.col("__d").alias("n_dup_lines"), F.col("__r").alias("n_repeat_words"), failed.alias("base_failed"), kept.alias("kept"), clean.alias("text"))
    return d.select(*docs.columns, q.alias("__q"))


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept: a row for each row."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return measured(docs.select("doc_id", "text")).select("doc_id", *(F.col(f"__q.{x}").alias(x) for x in names))


def cleaned(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with all their columns, whatever their names; text without its failing lines (a text whose
    lines all pass stays as it is, blank lines too), and n_chars, where there is one, its new length. A null text has too
    few words; a null doc_id makes no difference; equal rows stay; an empty table stays empty."""
    own = {c: "text" if c == "text" else f"__c{i}" for i, c in enumerate(docs.columns)}
    d = measured(docs.select(*(F.col(f"`{c}`").alias(name) for c, name in own.items())))
    # a generator keeps the filter above what it reads: a plain one, pushed below, would measure each text twice
    d = d.select(*own.values(), F.explode(F.filter(F.array("__q"), lambda q: q["kept"])).alias("__q"))
    same = F.length(F.translate("__q.text", _BLANKS + " ", "")) == F.col("__q.word_chars")
    new = F.when(same, F.col("text")).otherwise(F.col("__q.text"))
    return d.select(*(new.alias(c) if c == "text" else F.length(new).cast("long").alias(c) if c == "n_chars" else F.col(name).alias(c) for c, name in own.items()))


_ORACLE_WORDS = "list_filter(string_split(translate(coalesce({0}, ''), chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     '), ' '), lambda w: w <> '')"
_ORACLE_CHARS = "length(translate({0}, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ', ''))"


def _oracle_fails(x: str) -> str:
    words = f"greatest(len({_ORACLE_WORDS.format(x)}), 1)"
    n = lambda chars: f"(length({x}) - length(translate({x}, '{chars}', '')))"
    phrases = " or ".join(f"contains(lower({x}), '{p}')" for p in BOILERPLATE)
    return (
        f"(5 * len(list_filter({_ORACLE_WORDS.format(x)}, lambda w: w in ('|', '>', '»', '•'))) >= {words})"
        f" or ({words} < {SHORT_LINE} and not regexp_matches(rtrim(translate({x}, chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     '), ' '), '[.!?:;\"”…]$'))"
        f" or 10 * {n(_SYMBOLS)} >= {_ORACLE_CHARS.format(x)}"
        f" or (contains({x}, '!!') and 3 * (length({x}) - length(replace({x}, '!!', ''))) >= 2 * {words})"
        f" or {phrases} or {n('{}')} > 1 or contains({x}, '©') or 3 * {n(_DIGITS)} > 2 * {_ORACLE_CHARS.format(x)}"
        f" or ({words} < {ADDRESS_LINE} and ({_addressed(x)}))"
    )


#: A relation q over documents, with every column of documents that is not text, and what measured() gives.
ORACLE_MEASURED = f"""
d as (select *, row_number() over () as k from documents),
words as (select k, {_ORACLE_WORDS.format("text")} as w from d),
lines as (select k, unnest(string_split(coalesce(text, ''), chr(10))) as l, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i from d),
solid as (select k, l, i, {_ORACLE_CHARS.format("l")} as c, ({_oracle_fails("l")}) as bad from lines where {_ORACLE_CHARS.format("l")} > 0),
per_line as (select k, count(*) - count(distinct l) as n_dup_lines, coalesce(sum(c) filter (not bad), 0) as kept_chars, bool_or(bad) as any_bad, string_agg(l, chr(10) order by i) filter (not bad) as clean from solid group by k),
triples as (select k, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as t from (select k, w, unnest(range(1, len(w) - 1)) as i from words)),
twice as (select k, i from triples qualify count(*) over (partition by k, t) > 1),
covered as (select k, count(distinct p) as n from (select k, unnest([i, i + 1, i + 2]) as p from twice) group by k),
base as (select d.*, len(w) as n_words, {_ORACLE_CHARS.format("coalesce(text, '')")} as word_chars, length(coalesce(text, '')) - length(translate(coalesce(text, ''), '{_SYMBOLS}', '')) as n_symbols,
  coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n, 0) as n_repeat_words, coalesce(kept_chars, 0) as kept_chars, coalesce(any_bad, false) as any_bad, clean
  from d join words using (k) left join per_line using (k) left join covered using (k)),
q as (select *, (n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) as base_failed,
  not (n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) and 100 * kept_chars >= {100 - MAX_LOSS} * word_chars as kept from base)
"""
ORACLE = f"""with {ORACLE_MEASURED}
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols, cast(n_dup_lines as bigint) as n_dup_lines, cast(n_repeat_words as bigint) as n_repeat_words, base_failed, kept from q"""
