"""A document at a time: what segment, classify, graphs, score, choose and evaluate say by expressions, from the text alone.

Documents stay in their rows: nothing is dealt out by sentence, unit or pair of
units, and nothing is gathered again. It knows the plain splitter and the
LEXICAL extractors; what a caller brings goes through the expressions.
"""

from __future__ import annotations

import functools
import json
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import choose, classify, evaluate, graphs, score

#: Unicode's white space, as Java's (?U) has it, and ASCII's, as Java has it without.
WS = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_S, _DOT = r"[ \t\n\x0b\f\r]", r"[^\n\r\x85\u2028\u2029]"
_item = re.compile(rf"(?:[0-9]+\.|[*-]){_S}").match
# Where a list item could start: the marks of one at a line's start, but for tags. A sentence that is one starts there.
_marks = re.compile(rf"(?:\A|\n)[{WS.replace('\n', '')}]*(?:[0-9]+\.|\*|-(?![ \t]*\[[A-Z]+-[0-9]+\]))(?={_S}|\Z)")
_split = re.compile(rf"(?<=[.!?]){_S}+(?=[A-Z])").split
_tag_start = re.compile(rf"(?:-{_S}*)?\[[A-Z]+-[0-9]+\]").match
_rule = re.compile(r"[-*=_ \t\n\x0b\f\r]{3,}").fullmatch
_header_ends = re.compile(r"^[# \t]+|[# \t]+\Z").sub
_tag = re.compile(rf"(?:-{_S}*)?\[([A-Za-z]+)-[0-9]+\]{_S}*([^:]+):{_S}*({_DOT}*)").match
_label = re.compile(rf"(?:#+{_S}*)?([\w \t\n\x0b\f\r-]+):{_S}*({_DOT}*)").match
_words = re.compile(r"\w+").findall
_runs = re.compile(rf"[^{WS}]+").findall
_marked = re.compile("|".join(graphs.MARKERS)).search


def sentences(text: str) -> list[str]:
    """Sentences in order, stripped."""
    lines, merged, k = text.split("\n"), [], 0
    while k < len(lines):
        line = lines[k]
        if k + 1 < len(lines) and line.count(":") == 1 and (label := line.strip(WS)).endswith(":") and (after := lines[k + 1].strip(WS)) and not _item(after):
            merged.append(f"{line[: len(line) - len(line.lstrip(WS))]}{label} {after}")
            k += 2
        else:
            merged.append(line)
            k += 1
    out: list[str] = []
    for p in "\n".join(merged).split("\n\n"):
        p = p.strip(WS)
        own = [x.strip(WS) for x in p.split("\n")]
        if any(map(_item, own)):
            for x in own:
                out += [x] if _item(x) or x.endswith(":") else _split(x)
        elif p:
            out += _split(p)
    return [s for s in (s.strip(WS) for s in out) if s]


def _grouped(own: list[str]) -> Iterator[tuple[int, int, int]]:
    """For each unit of sentences, where it and its steps start, and where both end; what has no steps ends where they would start."""
    listed, k = [bool(_item(s)) and not _tag_start(s) for s in own], 0
    while k < len(own):
        end = begin = k if listed[k] else k + 1
        if listed[k] or (begin < len(own) and listed[begin] and not _rule(own[k])):
            while end < len(own) and listed[end]:
                end += 1
        yield k, begin, end
        k = end


def _neighbours(own: list[str], groups: Iterable[tuple[int, int, int]]) -> list[tuple[frozenset, frozenset]]:
    """The words of either of neighbouring steps."""
    words = [[frozenset(_words(s.lower())) for s in own[begin:end]] for _, begin, end in groups if end > begin + 1]
    return [pair for steps in words for pair in zip(steps, steps[1:])]


def _may_have_pairs(text: str) -> bool:
    marks = _marks.finditer(text)
    return bool(next(marks, None) and next(marks, None))


def step_pairs(text: str) -> list[tuple[frozenset, frozenset]]:
    """The words of either of neighbouring steps, of each workflow."""
    return _neighbours(own := sentences(text), _grouped(own)) if _may_have_pairs(text) else []


def _typed(text: str, low: str) -> tuple[str, str, str]:
    """Type, subject and object of a sentence."""
    if m := _tag(text):
        return classify.TAGS.get(m[1].upper(), "fact"), m[2].strip(WS), m[3].strip(WS)
    if ":" in text and (m := _label(text)) and m[2]:
        label = "_".join(m[1].split()).lower()
        return classify.LABELS.get(label) or (label if label in classify.WEIGHTS else "fact"), "", m[2]
    for kind, cues in classify.CUES:
        for c in cues:
            if c in low:
                return kind, "", text
    return ("question" if low.endswith("?") or "open question" in low else "fact"), "", text


class Unit:
    """A unit, as classify.units has it. low: its text in lower case."""

    __slots__ = ("at", "text", "low", "kind", "subject", "object", "header", "render", "steps", "name", "_words")

    def __init__(self, at, text, header, steps, name):
        self.at, self.text, self.low, self.header, self.steps, self.name, self._words = at, text, text.lower(), header, steps, name, None
        if steps is None:
            self.kind, self.subject, self.object = _typed(text, self.low)
            self.render = text
        else:
            self.kind, self.subject, self.object = "workflow", "", ""
            listed = ",\n".join(f"    {json.dumps(s)}" for s in steps)
            self.render = f'{{\n  "type": "workflow",\n  "name": {json.dumps(name)},\n  "steps": [\n{listed}\n  ]\n}}'

    @property
    def words(self) -> frozenset:
        if self._words is None:
            self._words = frozenset(_words(self.low))
        return self._words

    @property
    def same(self) -> tuple:
        return self.kind, self.subject.lower(), self.object.lower()


def tokens(text: str) -> int:
    return max(1, -(-len(text) // 4)) if text.strip(WS) else 0


class Document:
    """The units of a text, in order, and what follows from them."""

    def __init__(self, text: str):
        own, self.units = sentences(text), []
        self.n_sentences = len(own)
        headers, header, was = [], "", False
        heads = []
        for s in own:
            if first := s.startswith("# "):
                headers = [*headers, _header_ends("", s)] if was else [_header_ends("", s)]
                header = " | ".join(headers)
            was = first
            heads.append(header)
        for k, begin, end in _grouped(own):
            if end > begin:
                name = own[k].rstrip(":").strip(WS) if begin > k else "Unnamed Workflow"
                self.units.append(Unit(k, "\n".join(own[k:end]), heads[k], own[begin:end], name))
            else:
                self.units.append(Unit(k, own[k], heads[k], None, None))

    @functools.cached_property
    def edges(self) -> set[tuple[int, int]]:
        """Reasoning edges, in both directions."""
        out, last, units = set(), {}, self.units
        for k, u in enumerate(units):
            for back in graphs.LOOKS_BACK.get(u.kind, ()):
                if (t := last.get(back)) is not None and abs(t - u.at) <= graphs.FARTHEST:
                    out.add((u.at, t))
                    out.add((t, u.at))
            if _marked(u.low):
                for j in range(max(0, k - graphs.NEAR_UNITS), min(len(units), k + graphs.NEAR_UNITS + 1)):
                    if j != k and abs(units[j].at - u.at) <= graphs.NEAR_SENTENCES:
                        out.add((u.at, units[j].at))
                        out.add((units[j].at, u.at))
            last[u.kind] = u.at
        return out

    def connectivity(self) -> list[int]:
        at, own = defaultdict(set), []
        for u in self.units:
            nodes = {u.subject.lower(), u.object.lower()} - {""}
            own.append(nodes)
            if u.kind != "workflow":
                for x in nodes:
                    at[x].add(u.at)
        return [sum(len(at[x]) for x in nodes) for nodes in own]

    def frequencies(self, terms: frozenset) -> Counter:
        """In how many units each of the terms is a word."""
        return Counter(t for u in self.units for t in u.words & terms)


def idf(n: int, df: int) -> float:
    return math.log(n / (1 + df)) + 1 if df else 1.0


@functools.lru_cache(1 << 16)
def _rounded(x: float) -> float:
    """To nine digits, halves away from zero."""
    y = x * 1e9
    return round(x, 9) if abs(y - math.floor(y) - 0.5) > 1e-3 else float(Decimal(repr(x)).quantize(Decimal("1e-9"), ROUND_HALF_UP))


class Asked:
    """Questions, from the rows of score.question_features."""

    def __init__(self, rows):
        self.rows = sorted(rows, key=lambda r: r["query_id"])
        self.terms = sorted({t for r in self.rows for t in r["terms"]})
        self.known = frozenset(self.terms)
        self.own = [(frozenset(r["terms"]), [(h, h.lower()) for h in r["hard_identifiers"]], " ".join(r["clean_words"]), r["entities"], r["noun_chunks"], bool(set(r["terms"]) & set(score.PROCESS_WORDS))) for r in self.rows]
        self.kinds = [{t: score.INTENT_WORTH * bool(set(t.split("_")) & own[0]) + score.INTENT_WORTH * (t == "workflow" and own[5]) for t in {*classify.WEIGHTS, *classify.TAGS.values(), "workflow"}} for own in self.own]
        self.plain = not any(own[3] or own[4] for own in self.own)
        self.phrases, self.ids = [own[2] for own in self.own if len(own[2]) > 4], [x for own in self.own for x in own[1]]

    def scores(self, doc: Document) -> list[list[float]]:
        """For each question the score of each unit, as score.scored has it without dense scores."""
        df, n = doc.frequencies(self.known), len(doc.units)
        weights = {t: idf(n, df[t]) for t in self.terms}
        out: list[list[float]] = [[] for _ in self.own]
        known: dict[tuple, list[float]] = {}  # where nothing but type, links and terms counts
        for u, links in zip(doc.units, doc.connectivity()):
            low, text, kind = u.low, u.text, u.kind
            worth, near, kept = classify.WEIGHTS.get(kind, classify.OTHER_WEIGHT) * score.TYPE_WORTH, min(links * score.LINK_WORTH, score.MOST_LINKS), kind in score.PRESERVED
            hits = [t for t in self.terms if t in low]
            key = None
            if self.plain and not any(p in low for p in self.phrases) and not any(h in text or x in low for h, x in self.ids):
                key = kind, near, *hits
                if key in known:
                    for own, x in zip(out, known[key]):
                        own.append(x)
                    continue
            for k, (terms, ids, phrase, entities, chunks, _) in enumerate(self.own):
                m, lexical = 0, 0.0
                for t in hits:
                    if t in terms:
                        lexical += weights[t]
                        m += 1
                if m > 1:
                    lexical *= score.FURTHER_TERM ** (m - 1)
                hard = score.IDENTIFIER_WORTH * sum(h in text or x in low for h, x in ids) if ids else 0.0
                entity = noun = 0.0
                if entities:
                    entity = score.ENTITY_WORTH * sum(e in low for e in entities) + score.PRONOUN_WORTH * (not set(score.PRONOUNS).isdisjoint(_runs(low)))
                if chunks:
                    noun = score.NOUN_WORTH * sum(c in low for c in chunks)
                said = score.PHRASE_WORTH if len(phrase) > 4 and phrase in low else 0.0
                priority = score.PRIORITY if kept and (lexical > 0 or entity > 0 or noun > 0 or hard > 0) else 0.0
                out[k].append(_rounded(worth + lexical + said + entity + noun + near + self.kinds[k][kind] + hard + priority))
            if key:
                known[key] = [own[-1] for own in out]
        return out


class Reduction:
    """A document, ready to be reduced for any scores."""

    def __init__(self, doc: Document):
        self.doc, self.same, self.at = doc, [u.same for u in doc.units], [u.at for u in doc.units]
        self.tokens = [tokens(u.render) for u in doc.units]
        self.next = defaultdict(set)
        for a, b in doc.edges:
            self.next[a].add(b)

    def greedy(self, scores: list[float], s) -> list[int]:
        units, chosen, words, same, total = self.doc.units, [], [], set(), 0
        for k in sorted(range(len(units)), key=lambda k: -scores[k]):
            if self.same[k] in same or self._repeats(own := units[k].words, words):
                continue
            total += self.tokens[k]
            if s.max_tokens and total > s.max_tokens:
                break
            chosen.append(k)
            words.append(own)
            same.add(self.same[k])
            if len(chosen) >= s.max_sentences and (total >= s.min_tokens or (s.max_tokens and total >= s.max_tokens)):
                break
        return chosen

    @staticmethod
    def _repeats(a: frozenset, chosen: list[frozenset]) -> bool:
        n = len(a)
        for b in chosen:
            m = len(b)
            if (m > n * choose.REPEATS if m < n else n > m * choose.REPEATS) and (both := len(a & b)) and both / (n + m - both) > choose.REPEATS:
                return True
        return False

    def kept(self, chosen: tuple[int, ...], window: int) -> list[int]:
        """Of the chosen, in order, after neighbours and two hops along the edges."""
        if not chosen:
            return []
        own, at = list(chosen), self.at
        if window:
            seen = {self.same[k] for k in own}
            for k in sorted({k for c in own for k in range(bisect_left(at, at[c] - window), bisect_right(at, at[c] + window))}):
                if self.same[k] not in seen:
                    seen.add(self.same[k])
                    own.append(k)
        reached = {at[k] for k in own}
        for _ in range(2):
            reached |= {t for x in reached for t in self.next.get(x, ())}
        out, seen = [], set()
        for k in sorted({k for x in reached for k in range(bisect_left(at, x), bisect_right(at, x))}):
            if self.same[k] not in seen:
                seen.add(self.same[k])
                out.append(k)
        return out

    def context(self, kept: list[int]) -> str:
        out, last = [], ""
        for k in kept:
            u = self.doc.units[k]
            if u.header and not u.text.startswith("#") and u.header != last:
                last = u.header
                out.append(f"[{last}]\n{u.render}")
            else:
                out.append(u.render)
        return "\n".join(out).strip(WS)


def reductions(doc: Document, asked: Asked, s) -> Iterator[tuple[str, str, int, int, int]]:
    """query_id, context, and how many sentences there were, were kept and were chosen, for each question; nothing for a text without units."""
    if doc.units:
        own, known = Reduction(doc), {}
        for row, scores in zip(asked.rows, asked.scores(doc)):
            chosen = tuple(sorted(own.greedy(scores, s)))
            if chosen not in known:
                kept = own.kept(chosen, s.context_window)
                known[chosen] = own.context(kept), len(kept)
            context, n = known[chosen]
            yield row["query_id"], context, doc.n_sentences, n, len(chosen)


class Likest:
    """Sets of words, to be found by those that are like them."""

    def __init__(self, sets: list[frozenset]):
        self.sets, self.first, self.having = sets, {}, defaultdict(list)
        for k, own in enumerate(sets):
            if own not in self.first:  # of equals, the earliest
                self.first[own] = k
                for w in own:
                    self.having[w].append(k)

    def alike(self, v: frozenset) -> Iterator[tuple[float, int]]:
        """Cosine and place of each distinct set that is like v. Two that are like share ALIKE squared of the words of either, so one of the rarest."""
        least = math.ceil(len(v) * evaluate.ALIKE**2 - 1e-9)
        rare = sorted((self.having.get(w, ()) for w in v), key=len)[: len(v) - least + 1]
        for k in {k for own in rare for k in own}:
            like = len(v & self.sets[k]) / math.sqrt(len(v) * len(self.sets[k]))
            if like >= evaluate.ALIKE:
                yield like, k

    def best(self, v: frozenset) -> int | None:
        """The place of the likest, the earliest of equals."""
        if not v:
            return None
        if v in self.first:
            return self.first[v]
        found = max(((like, -k) for like, k in self.alike(v)), default=None)
        return found and -found[1]


def graph_recalls(doc: Document, contexts: list[Document | None]) -> list[float | None]:
    """As evaluate.graph_recall, of each context; None is the document itself."""
    edges = doc.edges
    if not edges:
        return [None] * len(contexts)
    own, memo, out = Likest([u.words for u in doc.units]), {}, []
    for c in contexts:
        if c is None:
            out.append(1.0)
            continue
        to, found = {}, c.edges
        ends = {x for e in found for x in e}
        for u in c.units:
            if u.at in ends:
                if u.words not in memo:
                    memo[u.words] = own.best(u.words)
                if (k := memo[u.words]) is not None:
                    to[u.at] = doc.units[k].at
        out.append(sum((to.get(a), to.get(b)) in edges for a, b in found) / len(edges))
    return out


def dependency_recalls(text: str, asked: Asked, s) -> list[tuple[str, float | None]]:
    """query_id and recall, as evaluate.dependency_recall, of what is retrieved for each question, and of the first half and the whole of a text.

    A text is reduced only if its contexts can have steps at all: without neighbouring steps there is nothing to recall, and
    a context is made of sentences that are no workflow's, headers, and workflows as JSON, whose lines are no list items.
    """
    own = sentences(text) if _may_have_pairs(text) else []
    groups = list(_grouped(own))
    pairs = Counter(_neighbours(own, groups))
    if pairs and _may_list(own, groups):
        contexts = [(q, context) for q, context, *_ in reductions(Document(text), asked, s)]
    else:
        contexts = [(r["query_id"], "") for r in asked.rows if text.strip(WS)]
    n, known, out = pairs.total(), {}, []
    for q, context in [*contexts, ("half", text[: len(text) // 2])]:
        if context not in known:  # those of several questions may be one
            known[context] = _preserved(pairs, set(step_pairs(context))) / n if n else None
        out.append((q, known[context]))
    return [*out, ("whole", 1.0 if n else None)]


def _may_list(own: list[str], groups: list[tuple[int, int, int]]) -> bool:
    """Whether a list item could start in a sentence outside of workflows, or in a header as contexts show it."""
    return any(end == begin and _marks.search(own[k]) for k, begin, end in groups) or any(_marks.search("[" + _header_ends("", x)) for x in own if x.startswith("# "))


def _preserved(pairs: Counter, found: set) -> int:
    """How many of the pairs are like a found one in both steps."""
    if not found:
        return 0
    firsts, seconds, hit = Likest(list({a for a, _ in found})), defaultdict(list), 0
    for a, b in found:
        seconds[a].append(b)
    for (a, b), times in pairs.items():
        if a and b and ((a, b) in found or any(len(b & y) / math.sqrt(len(b) * len(y)) >= evaluate.ALIKE for _, k in firsts.alike(a) for y in seconds[firsts.sets[k]] if y)):
            hit += times
    return hit


def mapped(rows: DataFrame, each, schema: str, at_once: int = 2000) -> DataFrame:
    """Rows of the schema, from each(*row) that gives tuples."""
    import pyarrow as pa

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kinds = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        def batch(out):
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), kinds)], schema=kinds)

        out = []
        for b in batches:
            for k in range(0, b.num_rows, 200):
                for row in zip(*[c.to_pylist() for c in b.slice(k, 200).columns]):
                    out.extend(each(*row))
                    if len(out) >= at_once:
                        yield batch(out)
                        out = []
        if out:
            yield batch(out)

    return rows.mapInArrow(run, schema)


def reduced(docs: DataFrame, features: list, s) -> DataFrame:
    """document_id, query_id, context, original_sentences, reduced_sentences, selected_sentence_count, original_chars, original_estimated_tokens."""
    asked = Asked([r.asDict() for r in features])

    def each(document_id, text):
        chars, size = len(text), tokens(text)
        return [(document_id, q, context, n, kept, chosen, chars, size) for q, context, n, kept, chosen in reductions(Document(text), asked, s)]

    return mapped(docs.where("document_id is not null and text is not null").select("document_id", "text"), each, "document_id string, query_id string, context string, original_sentences int, reduced_sentences int, selected_sentence_count int, original_chars int, original_estimated_tokens int")


def units(docs: DataFrame, terms: list[str] = ()) -> DataFrame:
    """The columns of classify.units, connectivity, and idf, the weights of those of the terms that the document has as words."""
    known = frozenset(t for t in terms if len(t) >= 2)

    def each(document_id, text):
        doc = Document(text)
        weights = [(t, math.log(len(doc.units) / (1 + n)) + 1) for t, n in sorted(doc.frequencies(known).items())] if known else []
        for k, (u, links) in enumerate(zip(doc.units, doc.connectivity())):
            yield document_id, k, u.at, u.text, u.kind, u.subject, "", u.object, u.header, u.render, u.steps, u.name, links, weights

    return mapped(docs.where("text is not null").select("document_id", "text"), each, "document_id string, unit_pos int, sentence_index int, text string, unit_type string, subject string, relation string, object string, context_header string, render_text string, steps array<string>, workflow_name string, connectivity long, idf map<string,double>")


def meta(docs: DataFrame) -> DataFrame:
    """As engine.document_meta."""
    def each(document_id, text):
        n = len(sentences(text))
        return [(document_id, len(text), n, tokens(text))] if n else []

    return mapped(docs.where("document_id is not null and text is not null").select("document_id", "text"), each, "document_id string, original_chars int, original_sentences int, original_estimated_tokens int")


def recalls(docs: DataFrame, features: list, s, kind: str) -> DataFrame:
    """document_id, query_id, recall of what is retrieved for each question, and of the first half and the whole of each document."""
    asked = Asked([r.asDict() for r in features])

    def each(document_id, text):
        if kind == "dependency":
            return [(document_id, *x) for x in dependency_recalls(text, asked, s)]
        doc = Document(text)
        own = [*((q, context) for q, context, *_ in reductions(doc, asked, s)), ("half", text[: len(text) // 2])]
        contexts = list(dict.fromkeys(context for _, context in own))  # those of several questions may be one
        *each_, all_ = graph_recalls(doc, [*map(Document, contexts), None])
        found = dict(zip(contexts, each_))
        return [*((document_id, q, found[context]) for q, context in own), (document_id, "whole", all_)]

    return mapped(docs.select("document_id", F.coalesce("text", F.lit("")).alias("text")), each, "document_id string, query_id string, recall double")
