"""Token and tag algebra as column functions.

A token is a tag, a run of white space, a punctuation mark, a word or another character.  A lone "<" or
">" belongs to no token.  All functions stay inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The alternatives of the tokenizer, in order.
PUNCTUATION = r"""[.,;:!?()\[\]{}"'`‑–—]"""
TOKEN = r"(?U)(<[^>]*>)|(\s+)|(" + PUNCTUATION + r")|(\w+)|([^\w\s<>])"
WORD = r"(?U)[^\W_]+(?:['’\-][^\W_]+)*"


def tokenize(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def decode(tokens: Column) -> Column:
    return F.array_join(tokens, "")


def is_tag(token: Column) -> Column:
    return (F.length(token) >= 3) & token.startswith("<") & token.endswith(">")


def is_closing(token: Column) -> Column:
    return is_tag(token) & token.startswith("</")


def is_opening(token: Column) -> Column:
    return is_tag(token) & ~token.startswith("</")


def label_kind(token: Column) -> Column:
    """1 for tags of manual labels, 2 for those of automatic ones, else 0."""
    low = F.lower(token)
    return F.when(low.rlike(r"^</?manual_label[\s>]"), 1).when(low.rlike(r"^</?auto_label[\s>]"), 2).otherwise(0)


def token_kind(token: Column) -> Column:
    """tag, space, punctuation, word or other."""
    return (
        F.when(token.rlike(r"^<[^>]*>$"), "tag").when(token.rlike(r"(?U)^\s"), "space").when(token.rlike("^" + PUNCTUATION + "$"), "punctuation")
        .when(token.rlike(r"(?U)^\w"), "word").otherwise("other")
    )


def tag_name(token: Column) -> Column:
    """The name of a tag: the words up to the first that has "=" (names may have spaces)."""
    inner = F.regexp_replace(token, r"^</?|/?>$", "")
    return F.trim(F.regexp_replace(inner, r"\s+[^\s=]+\s*=[\s\S]*$", ""))


def is_tag_named(token: Column, name: str) -> Column:
    return is_tag(token) & (F.lower(tag_name(token)) == name.lower())


def body_of(html: Column) -> Column:
    """The body element where there is one, else all."""
    body = F.regexp_extract(html, r"(?is)<body\b.*</body>", 0)
    return F.when(body != "", body).otherwise(html)


def without_bookmarks(html: Column) -> Column:
    """Without the annotation tool's bookmark elements; an unclosed one takes the rest."""
    return F.regexp_replace(html, r"(?is)<([a-z]+_bookmark)\b.*?(</\1[^>]*>|$)", "")


def without_auto_labels(html: Column) -> Column:
    return F.regexp_replace(html, r"(?i)</?auto_label[^>]*>", "")


def without_tags(text: Column) -> Column:
    return F.regexp_replace(text, r"<[^>]*>", "")


def clean_tokens(html: Column, keep: str | None = None) -> Column:
    """Tokens of html without tags, but for those that match keep; white space that meets is one token.

    Text tokens hold no white space, so joining what stays and cutting it again is the same as merging.
    """
    dropped = r"<[^>]*>" if keep is None else rf"(?i)<(?!(?:{keep}))[^>]*>"
    return tokenize(F.regexp_replace(html, dropped, ""))


def normalized_spaces(tokens: Column) -> Column:
    """White-space tokens of two characters or more become one space."""
    return F.transform(tokens, lambda t: F.when(t.rlike(r"(?U)^\s{2,}$"), " ").otherwise(t))


def squeezed(text: Column) -> Column:
    """ASCII white space squeezed to single spaces and trimmed."""
    return F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "))


def fixed_tag_spacing(html: Column) -> Column:
    """White space right after an opening tag moves before it."""
    return F.regexp_replace(html, r"(<(?!/)[^>]+>)(\s+)", "$2$1")


def preceding(tokens: Column, position: Column, n: int) -> Column:
    """At most n tokens before the 1-based position."""
    first = F.greatest(position - n, F.lit(1))
    return F.slice(tokens, first, position - first)


def upper_context(html: Column, mention: Column, n: int = 500) -> Column:
    """At most n tokens before the mention's opening tag; null if it isn't found."""
    tokens = tokenize(html)
    at = F.array_position(tokens, mention)
    return F.when(at > 0, decode(preceding(tokens, at.cast("int"), n)))


def between_markers(tokens: Column, start: str = "<start>", end: str = "<end>") -> Column:
    """Tokens between the markers, all without markers, null for half a pair."""
    a, b = F.array_position(tokens, start), F.array_position(tokens, end)
    return F.when((a > 0) & (b > a), F.slice(tokens, (a + 1).cast("int"), (b - a - 1).cast("int"))).when((a == 0) & (b == 0), tokens)


def generated_docid(output: Column) -> Column:
    """The first docid="..." of a model's output, with plain or escaped quotes; blank is null."""
    return F.nullif(F.trim(F.regexp_extract(output, r"""(?s)docid\s*=\s*\\?["'](.*?)\\?["']""", 1)), F.lit(""))


def without_thoughts(output: Column) -> Column:
    return F.trim(F.regexp_replace(output, r"(?s)<think>.*?</think>", ""))


def final_channel(output: Column, start: str = "<|message|>", end: str = "<|eot|>", to: str = "to=user") -> Column:
    """The last message of an output with channels that is for the user; all of it where there is none."""
    found = F.regexp_extract_all(output, F.lit(rf"(?s)\Q{to}\E\s*\Q{start}\E(.*?)(?:\Q{end}\E|$)"), F.lit(1))
    return F.trim(F.when(F.size(found) > 0, F.get(found, F.size(found) - 1)).otherwise(output))


#: Entities that stand in attribute values (fixed values), the ampersand last.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&#x27;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def normalized_docid(docid: Column) -> Column:
    """Docids as they are compared: entities resolved, trimmed; null stays null."""
    for entity, char in ENTITIES:
        docid = F.replace(docid, F.lit(entity), F.lit(char))
    return F.trim(docid)


def label_count(html: Column) -> Column:
    """Opening label tags."""
    return F.regexp_count(html, F.lit(r"(?i)<(?:manual|auto)_label\b"))


def count_words(text: Column) -> Column:
    """Words of letters and digits, with apostrophes and hyphens within."""
    return F.regexp_count(text, F.lit(WORD))


def audit_uri(uri: Column) -> Column:
    """Links as the audit compares them: lower case, https, no www., no slash at the end."""
    low = F.lower(F.trim(uri))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(low, r"^http://", "https://"), r"^https://www\.", "https://"), r"/+$", "")


def scored_uri(uri: Column) -> Column:
    """Links as the scores compare them: lower case and trimmed."""
    return F.lower(F.trim(uri))


def uri_path(url: Column) -> Column:
    """The path without slashes at its end, the url where it has none; blank is null."""
    path = F.regexp_replace(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?#]*)", 1), r"/+$", "")
    return F.when(F.nullif(url, F.lit("")).isNull(), F.lit(None)).when(path != "", path).otherwise(url)


def doctype_key(doc_type: Column) -> Column:
    return F.replace(F.upper(F.trim(doc_type)), F.lit(" "), F.lit("_"))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != ""))


def citation_density(sentence: Column) -> Column:
    """Dots and digits per hundred characters; 0 under ten characters."""
    n = F.length(sentence)
    return F.when(n < 10, F.lit(0.0)).otherwise(100.0 * F.length(F.regexp_replace(sentence, r"[^.0-9]", "")) / n)


def hash8(text: Column) -> Column:
    """A number of 32 bits from md5, the same in other SQL engines."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")
