"""Text, token and time functions on columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from . import lexicon

HAN = r"\x{4e00}-\x{9fff}"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body uses it; keeps plans small as well."""
    return F.get(F.transform(F.array(value), body), 0)


def clean(text: Column) -> Column:
    """White space runs (Unicode) to one space, ends trimmed; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def first_filled(*texts: Column) -> Column:
    """The first that is not blank, cleaned; else empty."""
    return F.coalesce(*[F.nullif(clean(t), F.lit("")) for t in texts], F.lit(""))


def token(text: Column) -> Column:
    """Lower case, only a-z, 0-9 and Han."""
    return F.regexp_replace(F.lower(F.trim(text)), rf"[^a-z0-9{HAN}]+", "")


def normal_words(words: tuple[str, ...]) -> list[str]:
    return sorted({re.sub(r"[^a-z0-9一-鿿]+", "", w.lower()) for w in words} - {""})


def text_list(values: Column) -> Column:
    """Cleaned texts in order, blank ones out, each once; null is empty."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), clean), lambda v: v != ""))


def joined(*texts: Column) -> Column:
    """Texts that aren't empty, with spaces between."""
    return F.array_join(F.filter(F.array(*texts), lambda v: v != ""), " ")


def _source_like(t: Column) -> Column:
    return t.isin(normal_words(lexicon.SOURCE_LIKE_TOKENS)) | t.rlike(r"^(part|session|chapter)\d+$")


def source_like(text: Column) -> Column:
    return let(token(text), _source_like)


def weak(text: Column) -> Column:
    return token(text).isin(normal_words(lexicon.WEAK_TOKENS))


def platform_token(text: Column) -> Column:
    return token(text).isin(normal_words(lexicon.GENERIC_PLATFORM_TOKENS))


def _generated(t: Column) -> Column:
    digits = F.length(F.regexp_replace(t, r"[^0-9]+", ""))
    return t.rlike(r"^[0-9a-f]{12,}$") | ((F.length(t) >= 8) & (digits >= 0.45 * F.length(t)))


def generated_id(text: Column) -> Column:
    """At least 12 hexadecimal digits, or at least 8 characters of which 45 % or more are digits."""
    return let(token(text), _generated)


def slogan(text: Column) -> Column:
    """X your X, the same two to four Han characters; or five characters that name a platform's place and its people or things."""

    def is_slogan(t: Column) -> Column:
        return t.rlike(rf"^([{HAN}]{{2,4}})你的\1$") | ((F.length(t) >= 5) & t.rlike("|".join(lexicon.SLOGAN_PLACES)) & t.rlike("|".join(lexicon.SLOGAN_SUBJECTS)))

    return let(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", ""), is_slogan)


def noisy_token(t: Column, text: Column) -> Column:
    """Whether a text, with its token at hand, says nothing about a topic."""
    listed = normal_words(lexicon.NOISY_TOKENS + lexicon.GENERIC_PLATFORM_TOKENS)
    return (t == "") | t.isin(listed) | _source_like(t) | _generated(t) | (t.rlike(f"[{HAN}]") & slogan(text))


def noisy(text: Column) -> Column:
    return let(text, lambda v: let(token(v), lambda t: noisy_token(t, v)))


def low_signal_title(text: Column) -> Column:
    """Not empty, and without word characters, a slogan, an identifier, or six characters of which 60 % or more are digits."""

    def low(t: Column) -> Column:
        def of(core: Column) -> Column:
            digits = F.length(F.regexp_replace(core, r"(?U)\D+", ""))
            return (core == "") | slogan(t) | generated_id(t) | ((F.length(core) >= 6) & (digits >= 0.6 * F.length(core)))

        return (t != "") & let(F.regexp_replace(t, rf"(?U)[^\w{HAN}]+", ""), of)

    return let(clean(text), low)


def keyword_pattern(keyword: str) -> str:
    """A regular expression for a lower-case keyword: plain ASCII words between non-alphanumerics, others anywhere."""
    body = re.sub(r"([.+*?()\[\]{}|^$\\#-])", r"\\\1", keyword.lower())
    if re.fullmatch(r"[a-z0-9+.#/-]+", keyword.lower()):
        return rf"(?<![a-z0-9]){body}(?![a-z0-9])"
    return rf"\b{body}\b" if len(keyword) <= 2 and keyword.isascii() else body


def has_keyword(text: Column, keyword: str) -> Column:
    return F.lower(text).rlike(keyword_pattern(keyword))


def _kinds(keywords: list[str]) -> tuple[list[str], list[str], list[str], list[str]]:
    """Lower-case keywords: words of letters and digits, those with marks, those of other alphabets, and phrases with spaces."""
    words = sorted({k.lower() for k in keywords if k})
    plain = [k for k in words if re.fullmatch(r"[a-z0-9]+", k)]
    marked = [k for k in words if k not in plain and (re.fullmatch(r"[a-z0-9+.#/-]+", k) or (len(k) <= 2 and k.isascii()))]
    rest = [k for k in words if k not in plain and (k not in marked or re.search(r"\s", k))]
    return plain, [k for k in marked if k not in rest], [k for k in rest if not re.search(r"\s", k)], [k for k in rest if re.search(r"\s", k)]


def words_in(low: Column, keywords: list[str]) -> Column:
    """Which of the keywords without spaces a lower-case text holds."""
    plain, marked, other, _ = _kinds(keywords)
    parts = [F.array().cast("array<string>")]
    if plain:
        parts.append(F.array_intersect(F.array(*map(F.lit, plain)), F.split(low, "[^a-z0-9]+")))
    if marked:
        parts.append(F.array_compact(F.array(*[F.when(low.rlike(keyword_pattern(k)), F.lit(k)) for k in marked])))
    if other:
        searched = F.filter(F.array(*map(F.lit, other)), lambda k: F.contains(low, k))
        han = all(re.search("[一-鿿]", k) for k in other)
        parts.append(F.when(low.rlike(f"[{HAN}]"), searched).otherwise(F.array().cast("array<string>")) if han else searched)
    return F.concat(*parts)


def found_keywords(text: Column, keywords: list[str], pieces: list[Column] | None = None, found: list[Column] | None = None) -> Column:
    """Which of the keywords a text holds, as an array, from one pass over its words.

    Words of letters and digits are found by an intersection with the text's words; only keywords with marks in
    them need a pattern each, and those of several words or other alphabets a search each.  ``pieces`` are lower-case texts that the
    text is made of, with spaces between: words lie within a piece, so equal pieces are read once; phrases are searched in the whole.
    ``found`` is what further pieces are known to hold (of `words_in`).
    """
    plain, marked, other, phrases = _kinds(keywords)
    literals = lambda ks: F.array(*map(F.lit, ks)) if ks else F.array().cast("array<string>")
    low = F.lower(text)
    words_of = lambda p: words_in(p, keywords)
    if pieces is None:
        parts = [let(low, words_of)]
    else:
        own = F.flatten(F.transform(F.array_distinct(F.array_compact(F.array(*pieces))), words_of))
        known = [F.array_intersect(literals(plain + marked + other), x) for x in found or ()]
        parts = [F.array_distinct(F.concat(own, *known))]
    if phrases:
        parts.append(let(low, lambda p: F.array_compact(F.array(*[F.when(p.rlike(keyword_pattern(k)), F.lit(k)) for k in phrases]))))
    return F.concat(*parts)


def keyword_hits(found: Column, keywords: tuple[str, ...]) -> Column:
    """How many of the keywords are among those found; one that is listed twice counts twice."""
    return F.size(F.filter(F.array(*[F.lit(k.lower()) for k in keywords]), lambda k: F.array_contains(found, k))) if keywords else F.lit(0)


TOPIC_RUN = rf"[A-Za-z][A-Za-z0-9+#.-]{{2,}}|[{HAN}]{{2,}}"
HINT_RUN = rf"[A-Za-z][A-Za-z0-9+#.-]{{1,}}|[{HAN}]{{2,}}"


def topic_tokens(text: Column, run: str = TOPIC_RUN) -> Column:
    """Latin tokens of three or more characters (two for hints) and Han runs of two or more."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(run), 0)


def keywords(text: Column, repeats: bool = False) -> Column:
    """Lower-case words without stop words, single characters and noisy tokens, each once unless ``repeats``; hyphen and underscore part words."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[-_]", " "), r"(?U)[^\w\s]", " ")
    words = F.split(F.trim(plain), r"(?U)\s+")
    keyed = F.transform(words if repeats else F.array_distinct(words), lambda w: F.struct(w.alias("w"), token(w).alias("t")))
    kept = F.filter(keyed, lambda x: (F.length(x["w"]) > 1) & ~x["w"].isin(*lexicon.CLUSTER_STOPWORDS) & ~noisy_token(x["t"], x["w"]))
    return F.transform(kept, lambda x: x["w"])


def path_keywords(url: Column) -> Column:
    """Keywords of a link's path."""
    return keywords(F.replace(F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/?#]*)?([^?#]*)", 1), F.lit("/"), F.lit(" ")))


def url_types(path_words: Column) -> Column:
    """What the words of a path say about the kind of page."""
    return F.array_distinct(F.array_compact(F.transform(path_words, lambda w: F.try_element_at(lookup(lexicon.URL_TYPES), w))))


def lookup(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def segments(title: Column) -> Column:
    """What stands between bars and spaced dashes of a cleaned title, blank parts out."""
    return F.filter(F.transform(F.split(title, r"\s*[|｜]\s*|\s+[—–-]\s+"), F.trim), lambda s: s != "")


def leading_segment(title: Column) -> Column:
    """The first part of a title that isn't blank; the title if there is none."""
    return let(clean(title), lambda t: F.coalesce(F.get(segments(t), 0), t))


def human_label(value: Column) -> Column:
    """The leading part of a title without marks at its ends."""
    return F.btrim(leading_segment(value), F.lit(" /._-"))


def label_key(value: Column) -> Column:
    """Labels that differ by case, spaces, slashes, dots, dashes and underscores alone have one key."""
    return F.regexp_replace(F.lower(F.trim(F.coalesce(value, F.lit("")))), r"(?U)[\s_/.-]+", "")


def folder_key(name: Column) -> Column:
    """Folders that differ by case, spaces, slashes, dashes and underscores alone merge; no name: 其他."""
    key = clean(F.regexp_replace(F.lower(F.trim(F.coalesce(name, F.lit("")))), r"[_\-/]+", " "))
    return F.when(key == "", F.lit(lexicon.OTHER)).otherwise(key)


def capitalized(word: Column) -> Column:
    return F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substring(word, F.lit(2), F.length(word))))


def title_case(word: Column) -> Column:
    """Words in capitals or with digits stay; listed acronyms go to upper case; others are capitalised."""
    return F.when((word == F.upper(word)) | word.rlike(r"(?U)\d"), word).when(F.lower(word).isin(*lexicon.ACRONYMS), F.upper(word)).otherwise(capitalized(word))


def _labelled(text: Column) -> Column:
    """(words of a label without marks; which of them stay)"""
    plain = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"[_/]+", " "), r"(?U)[^\w\s.-]", " ")
    words = F.split(F.trim(F.regexp_replace(plain, r"(?U)\s+", " ")), " ")
    keyed = F.transform(words, lambda w: F.struct(w.alias("w"), token(w).alias("t")))
    kept = F.filter(keyed, lambda x: (x["w"] != "") & ~F.lower(x["w"]).isin(*lexicon.CLUSTER_STOPWORDS) & ~noisy_token(x["t"], x["w"]))
    return F.transform(kept, lambda x: x["w"])


def label(text: Column) -> Column:
    """A display label: marks to spaces, stop, noisy and repeated words out, known spellings; nothing left: 其他."""

    def shown(kept: Column) -> Column:
        once = F.filter(kept, lambda w, n: F.array_position(F.transform(kept, F.lower), F.lower(w)) == n + 1)
        return F.array_join(F.transform(once, lambda w: F.coalesce(F.try_element_at(lookup(lexicon.TOKEN_NAMES), F.lower(w)), w)), " ")

    return let(let(_labelled(text), shown), lambda x: F.when(x == "", F.lit(lexicon.OTHER)).otherwise(x))


def noisy_label(value: Column) -> Column:
    """A label that says nothing; an empty one is not noisy."""
    return let(human_label(value), lambda shown: (shown != "") & noisy(shown))


def generic_label(value: Column, category: Column | str = "") -> Column:
    """Empty, a listed folder name, a host name, noisy, or a part of the category."""
    category = F.lit(category) if isinstance(category, str) else F.coalesce(category, F.lit(""))
    folders = sorted({re.sub(r"[\s_/.-]+", "", f.lower()) for f in lexicon.GENERIC_FOLDERS})
    parts = F.transform(F.filter(F.split(category, "/"), lambda p: p != ""), label_key)

    def generic(shown: Column) -> Column:
        listed = let(label_key(shown), lambda key: key.isin(folders) | F.array_contains(parts, key))
        return (shown == "") | listed | F.lower(shown).rlike(r"^[a-z0-9.-]+\.[a-z]{2,}$") | noisy(shown)

    return let(human_label(value), generic)


def default_category(category: Column) -> Column:
    """No category, the default one, or one that only says 'other'."""
    c = category
    return c.isNull() | c.isin("", lexicon.DEFAULT_CATEGORY, lexicon.UNSORTED, lexicon.OTHER) | c.endswith("/其他") | c.endswith("/未分类")


def domain_name(registered: Column) -> Column:
    """How a site is called: listed names, up to four letters in capitals, others capitalised."""
    first = F.split_part(registered, F.lit("."), F.lit(1))
    plain = F.when(first == "", registered).when(F.length(first) <= 4, F.upper(first)).otherwise(capitalized(first))
    return F.coalesce(F.try_element_at(lookup(lexicon.DOMAIN_NAMES), registered), plain)


def repository_label(url: Column, registered: Column) -> Column:
    """The project's name of a code host's page, empty if it says nothing."""
    path = F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/?#]*)?([^?#]*)", 1)
    second = F.coalesce(F.get(F.filter(F.split(path, "/"), lambda s: s != ""), 1), F.lit(""))
    hosts = F.exists(F.array(*map(F.lit, lexicon.REPOSITORY_HOSTS)), lambda h: F.contains(registered, h))
    named = lambda name: F.when(hosts & ~generic_label(name) & ~weak(name), name).otherwise("")
    return let(second, lambda x: F.when(x == "", "").otherwise(let(label(F.trim(F.regexp_replace(x, r"(?i)\.git$", ""))), named)))


def resource_name(kind: Column) -> Column:
    """A kind of page under its listed name; none: 未知."""
    k = F.trim(F.coalesce(kind, F.lit("")))
    return F.when(k == "", F.lit(lexicon.UNKNOWN)).otherwise(F.coalesce(F.try_element_at(lookup(lexicon.RESOURCE_ALIASES), F.lower(k)), k))


def choose_resource(kinds: Column) -> Column:
    """The kind that comes first in the list of kinds, others after them by name; none: 未知."""
    order = F.create_map(*[F.lit(x) for n, k in enumerate(lexicon.RESOURCE_PRIORITY) for x in (k, n)])
    ranked = F.transform(kinds, lambda k: F.struct(F.coalesce(F.try_element_at(order, k), F.lit(len(lexicon.RESOURCE_PRIORITY))).alias("n"), k.alias("k")))
    return F.coalesce(F.array_min(ranked)["k"], F.lit(lexicon.UNKNOWN))


def category_leaf_label(category: Column, root: Column | None = None) -> Column:
    """The last two parts below the root as one label; the only part alone; nothing below the root: empty."""
    under = F.lit("") if root is None else root

    def below(parts: Column) -> Column:
        return F.when((under != "") & (F.get(parts, 0) == under), F.slice(parts, F.lit(2), F.size(parts))).otherwise(parts)

    rest = let(F.filter(F.split(F.coalesce(category, F.lit("")), "/"), lambda p: p != ""), below)
    shown = F.filter(F.transform(rest, human_label), lambda p: p != "")
    return let(shown, lambda x: F.array_join(F.slice(x, F.greatest(F.size(x) - 1, F.lit(1)), F.lit(2)), " / "))


def specific_domain(domain: Column) -> Column:
    """A host name that is not a bare public suffix such as org.cn."""
    d = F.lower(F.btrim(F.trim(F.coalesce(domain, F.lit(""))), F.lit(".")))
    return d.rlike(r"^[a-z0-9-]+(\.[a-z0-9-]+)+$") & ~d.rlike(r"^(ac|co|com|edu|gov|net|org)\.(cn|uk|jp|au)$")


def category_root(category: Column) -> Column:
    return F.split_part(category, F.lit("/"), F.lit(1))


def category_leaf(category: Column) -> Column:
    return F.coalesce(F.element_at(F.filter(F.split(category, "/"), lambda p: p != ""), -1), category)


def escape_html(text: Column) -> Column:
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(mark), F.lit(entity))
    return text


def stable_id(prefix: str, identities: Column) -> Column:
    """Prefix and 12 digits of the SHA-1 of sorted identities, one a line."""
    return F.concat(F.lit(prefix), F.substring(F.sha1(F.array_join(F.array_sort(identities), "\n").cast("binary")), 1, 12))


def time_bucket(epoch: Column) -> Column:
    """Year, year and month, ISO year and week (UTC) of epoch seconds as text; empty if not above zero."""
    seconds = epoch.try_cast("double").cast("bigint")
    at = F.when(seconds > 0, F.timestamp_seconds(seconds))
    week = F.concat(F.extract(F.lit("YEAROFWEEK"), at).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(at).cast("string"), 2, "0"))
    empty = F.lit("")
    return F.struct(F.coalesce(F.date_format(at, "yyyy"), empty).alias("year"), F.coalesce(F.date_format(at, "yyyy-MM"), empty).alias("year_month"), F.coalesce(week, empty).alias("year_week"))


def weighted_jaccard(a: Column, b: Column) -> Column:
    """Of two maps of weights: the sum of smaller weights over the sum of larger ones; 0 without weights."""
    keys = F.array_union(F.map_keys(a), F.map_keys(b))
    weight = lambda m, k: F.coalesce(F.try_element_at(m, k), F.lit(0.0))
    total = lambda pick: F.aggregate(keys, F.lit(0.0), lambda t, k: t + pick(weight(a, k), weight(b, k)))
    return F.when(total(F.greatest) > 0, total(F.least) / total(F.greatest)).otherwise(F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all members; 0 when either side is empty."""
    shared, union = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(shared / union)
