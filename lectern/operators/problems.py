"""TXT-0 … TXT-9, TXT-13, TXT-14, WIN-4, WIN-6: problem Markdown → question tables.

Problem documents are processed as a corpus, never one text in a Python loop:

    docs ──split at "---" lines──▶ parts ──labels / multi-line forms by regex──▶
    lines (posexplode) ──one ordered `when` gives each line a kind──▶
    runs (gaps-and-islands over the non-blank lines of a part) ──▶ responses ──▶ records

Every input ``docs`` frame has key columns (``keys``) plus ``text``. All steps are native
expressions; the per-document windows are bounded by one document's size.

Grammar (per part; the first matching form claims a line):

* ``>>label||description<<``            question label (may span lines)
* ``|| hint ||``                        demand hint (whole line)
* ``[[a, (b), c]]`` / multi-line ``[[`` dropdown (option response)
* ``(x) text {{label:: hint}}``         single choice; ``x``/``X`` inside the parentheses
                                        marks the answer, ``@`` fixed, ``!`` shuffles the group
* ``+(x) body … -(x)-``                  single choice whose body spans lines
* ``[x] text {{selected: …},{unselected: …}}``  checkbox choice; ``{{ ((A*B)) hint }}`` compound hint
* ``= 5 +- 0.1`` / ``= [5,7)`` / ``or= 6``      numeric answer (first answer parses as a number)
* ``s= text`` / ``= text``, ``or= …``, ``not= … {{hint}}``  string answer; ``|`` prefix = regexp

Record rules (TXT-13): one question per document. If a part holds exactly one response,
the part's labels belong to it. Kinds are chosen single → checkbox → string; a document
with none of these is unsupported (VAL-7). Repeated elements follow the reference's XML
decoding: choices accumulate in order, a label or answer seen again replaces the earlier
one, the demand hint is the last one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.ids import keyed
from lectern.functions.escaping import escape_code, unescape_code
from lectern.functions.markup import html_to_markdown
from lectern.functions.text import strip_hints

# Line patterns (Java regex), checked in this order.
RE_DEMAND_HINT = r"^\s*\|\|(.*?)\|\|\s*$"
RE_SINGLE = r"^\s*\((.{0,3})\)"
RE_CHECKBOX = r"^\s*\[(.?)\]"
RE_COMPOUND = r"^\s*\{\{\s*\(\((.*?)\)\)(.*?)\}\}"
RE_HINT_LINE = r"^\s*\{\{.*?\}\}"
RE_ANSWER = r"^s?=\s*(.*)$"
RE_MORE = r"^(or|not)=\s*(.*)$"
RE_LABEL = r"(?s)>>(.+?)<<"
RE_DROPDOWN = r"(?s)\[\[(.+?)\]\]"
RE_MULTILINE_CHOICE = r"(?s)\+\((.{0,3})\)(.*?)-\(.{0,3}\)-"
RE_PART_SPLIT = r"\n\s*---\s*\n"
RE_NUMERIC = r"^\s*[-+]?(\d|\.\d|Infinity)"
RE_HINT = r"\s*\{\{(.*?)\}\}"


# The response kinds that make a question, in the order they are chosen in.
SINGLE, MULTI, STRING = "multiplechoiceresponse", "choiceresponse", "stringresponse"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ------------------------------------------------------------------------ hint helpers


def hint_parts(text) -> Column:
    """extractHint: struct(nothint, hint, label) from ``text {{label:: hint}}``."""
    t = _c(text)
    found = t.rlike(RE_HINT)
    raw = F.trim(F.regexp_extract(t, RE_HINT, 1))
    has_label = raw.rlike(r"^(.*?)::")
    label = F.trim(F.regexp_extract(raw, r"^(.*?)::", 1))
    hint = F.when(has_label, F.trim(F.regexp_replace(raw, r"^(.*?)::", ""))).otherwise(raw)
    return F.struct(
        F.when(found, F.regexp_replace(t, RE_HINT, "")).otherwise(t).alias("nothint"),
        F.when(found, hint).otherwise(F.lit("")).alias("hint"),
        F.when(found & has_label, label).otherwise(F.lit("")).alias("label"),
    )


def _join_multiline_hints(text: Column) -> Column:
    """Inside each ``{{ … }}`` replace newline + indentation by one space."""
    segs = F.split(text, r"\{\{")

    def fix(s, i):
        inner = F.substring_index(s, "}}", 1)
        rest = F.substring(s, F.instr(s, "}}"), F.length(s))
        joined = F.concat(F.regexp_replace(inner, r"\r?\n[ \t]*", " "), rest)
        return F.when((i == 0) | (F.instr(s, "}}") == 0), s).otherwise(joined)

    return F.array_join(F.transform(segs, fix), "{{")


# ------------------------------------------------------------------------------ parts


def split_parts(docs: DataFrame, keys: list[str]) -> DataFrame:
    """TXT-0 / TXT-1: CRLF → LF, split at ``---`` lines, drop blank parts, escape code.

    Returns keys + ``part_idx`` (0-based among kept parts) + ``part``. Markup characters inside
    inline or fenced code are escaped (PRJ-21), so that no form matches there.
    """
    text = F.regexp_replace(F.col("text"), "\r\n", "\n")
    parts = F.filter(F.split(text, RE_PART_SPLIT), lambda p: F.trim(p) != "")
    split = docs.select(*keys, F.posexplode(parts).alias("part_idx", "part"))
    return split.withColumn("part", F.when(F.col("part").contains("`"), escape_code("part")).otherwise(F.col("part")))


def _plain(c) -> Column:
    """An extracted text with its code unescaped again (the text is bound once)."""
    return F.transform(F.array(_c(c)), lambda t: F.when(t.contains("`"), unescape_code(t)).otherwise(t))[0]


def _unescaped(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: _plain(c) for c in cols})


def _choice_markdown(c) -> Column:
    """Choice text or explanation: HTML → Markdown outside code, then the code unescaped."""
    return _plain(html_to_markdown(_c(c), keep_fences=True))


def question_labels(parts: DataFrame, keys: list[str]) -> DataFrame:
    """TXT-2: ``>>question||description<<`` → label, description (NULL when absent/empty)."""
    lab = parts.select(*keys, "part_idx",
                       F.posexplode(F.regexp_extract_all(F.col("part"), F.lit(RE_LABEL), 1)).alias("label_idx", "raw"))
    pieces = F.split(F.col("raw"), r"\|\|")
    return lab.select(*keys, "part_idx", "label_idx", pieces[0].alias("label"),
                      F.when(F.size(pieces) > 1, F.nullif(pieces[1], F.lit(""))).alias("description"))


def _part_body(parts: DataFrame) -> DataFrame:
    """The part text with labels, dropdowns and multi-line choices cut out and
    multi-line hints joined, plus the cut-out pieces."""
    p = parts.withColumn("body", F.regexp_replace(F.col("part"), RE_LABEL, ""))
    p = p.withColumn("dropdowns", F.regexp_extract_all(F.col("body"), F.lit(RE_DROPDOWN), 0))
    p = p.withColumn("body", _join_multiline_hints(F.regexp_replace(F.col("body"), RE_DROPDOWN, "\n")))
    p = p.withColumn("mlchoices", F.regexp_extract_all(F.col("body"), F.lit(RE_MULTILINE_CHOICE), 0))
    return p.withColumn("body", F.regexp_replace(F.col("body"), RE_MULTILINE_CHOICE, "\n"))


def problem_lines(parts: DataFrame, keys: list[str]) -> DataFrame:
    """TXT-0 + WIN-6: one row per line with its ``kind`` and ``run`` (gaps-and-islands).

    A run is a maximal sequence of same-kind lines in a part, blank lines and demand
    hints in between ignored (they are taken out before the response forms are matched).
    ``or=`` / ``not=`` lines continue an answer run.
    """
    # the parts are dealt by document, not their lines
    body = _part_body(keyed(parts, keys).repartition("_key"))
    lines = body.select("_key", *keys, "part_idx", F.posexplode(F.split(F.col("body"), "\n")).alias("line_no", "line"))
    ln = F.col("line")
    kind = (F.when(F.trim(ln) == "", F.lit("blank"))
            .when(ln.rlike(RE_DEMAND_HINT), F.lit("demand_hint"))
            .when(ln.rlike(RE_SINGLE), F.lit("single"))
            .when(ln.rlike(RE_COMPOUND), F.lit("compound"))
            .when(ln.rlike(RE_CHECKBOX) | ln.rlike(RE_HINT_LINE), F.lit("checkbox"))
            .when(ln.rlike(RE_ANSWER), F.lit("answer"))
            .when(ln.rlike(RE_MORE), F.lit("answer_more"))
            .otherwise(F.lit("text")))
    lines = lines.withColumn("kind", kind)
    # group kind: compound hints belong to checkbox runs, or=/not= to answer runs; blank lines and demand
    # hints have none, so that what comes before a line is the last one that has
    grp = (F.when(F.col("kind") == "compound", F.lit("checkbox"))
           .when(~F.col("kind").isin("blank", "demand_hint"), F.col("kind")))
    w = Window.partitionBy("_key", *keys, "part_idx").orderBy("line_no")
    lines = lines.withColumn("g", grp)
    prev = F.last("g", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    starts = ((prev.isNull()) | (prev != F.col("g"))) & ~(
        (F.col("g") == "answer_more") & F.coalesce(prev.isin("answer", "answer_more"), F.lit(False)))
    starts = starts | (F.col("g") == "answer")
    run = F.sum("is_start").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return (lines.withColumn("is_start", F.when(F.col("g").isNotNull(), starts.cast("int")))
            .withColumn("run", F.when(F.col("g").isNotNull(), run)).drop("is_start", "g", "_key"))


def demand_hints(lines: DataFrame, keys: list[str]) -> DataFrame:
    """TXT-3: demand hints in document order (trimmed)."""
    return (lines.filter(F.col("kind") == "demand_hint")
            .select(*keys, "part_idx", "line_no",
                    F.trim(F.regexp_extract(F.col("line"), r"\s*\|\|(.*?)\|\|", 1)).alias("hint")))


def choices_single(lines: DataFrame, keys: list[str]) -> DataFrame:
    """TXT-4: ``(x) text {{label:: hint}}`` lines; ``shuffle`` is set for the whole run."""
    s = lines.filter(F.col("kind") == "single")
    t = F.trim(F.col("line"))
    inparens = F.regexp_extract(t, r"^\s*\((.{0,3})\)\s*", 1)
    value = F.regexp_replace(t, r"^\s*\(.{0,3}\)\s*", "")
    h = hint_parts(value)
    out = s.select(*keys, "part_idx", "run", "line_no", inparens.alias("marks"), h.alias("h"))
    shuffle = F.max(F.col("marks").contains("!")).over(Window.partitionBy(*keys, "part_idx", "run"))
    return out.select(*keys, "part_idx", "run", "line_no",
                      F.col("marks").rlike("(?i)x").alias("correct"),
                      F.col("marks").contains("@").alias("fixed"),
                      shuffle.alias("shuffle"),
                      F.trim(F.col("h.nothint")).alias("text"),
                      F.col("h.hint").alias("hint"), F.col("h.label").alias("hint_label"))


def choices_single_multiline(parts: DataFrame, keys: list[str]) -> DataFrame:
    """TXT-5: ``+(x) … -(x)-`` bodies (code and newlines allowed) as single choices."""
    body = _part_body(parts.filter(F.col("part").contains("+")))
    lines = F.size(F.split(F.col("body"), "\n")).alias("n_lines")  # they come after every single line
    blocks = body.select(*keys, "part_idx", lines, F.posexplode("mlchoices").alias("pos", "raw"))
    marks = F.regexp_extract(F.col("raw"), r"^\+\((.{0,3})\)", 1)
    inner = F.trim(F.regexp_replace(F.regexp_replace(F.col("raw"), r"^\+\(.{0,3}\)\s*", ""),
                                    r"\s*-\(.{0,3}\)-$", ""))
    h = hint_parts(inner)
    out = blocks.select(*keys, "part_idx", (F.col("n_lines") + F.col("pos")).alias("line_no"), marks.alias("marks"), h.alias("h"))
    shuffle = F.max(F.col("marks").contains("!")).over(Window.partitionBy(*keys, "part_idx"))
    return out.select(*keys, "part_idx", F.lit(-1).cast("bigint").alias("run"), "line_no",
                      F.col("marks").rlike("(?i)x").alias("correct"),
                      F.col("marks").contains("@").alias("fixed"), shuffle.alias("shuffle"),
                      F.col("h.nothint").alias("text"), F.col("h.hint").alias("hint"),
                      F.col("h.label").alias("hint_label"))


def choices_multi(lines: DataFrame, keys: list[str]) -> DataFrame:
    """TXT-6: checkbox choices with selected / unselected hints.

    The text loses its hint markup only when the ``selected:``/``unselected:`` syntax is
    recognised; otherwise it is kept as typed.
    """
    s = lines.filter((F.col("kind") == "checkbox") & F.col("line").rlike(RE_CHECKBOX))
    value = F.regexp_replace(F.col("line"), r"^\s*\[.?\]\s*", "")
    h = hint_parts(value)
    inner = F.concat(F.lit("{"), F.col("h.hint"), F.lit("}"))
    sel = F.regexp_extract(inner, r"(?is)\{\s*(?:s|selected):(.*?)\}", 1)
    unsel = F.regexp_extract(inner, r"(?is)\{\s*(?:u|unselected):(.*?)\}", 1)
    has_sel = inner.rlike(r"(?is)\{\s*(?:s|selected):(.*?)\}") & (F.col("h.hint") != "")
    has_unsel = inner.rlike(r"(?is)\{\s*(?:u|unselected):(.*?)\}") & (F.col("h.hint") != "")
    out = s.select(*keys, "part_idx", "run", "line_no", F.col("line"), value.alias("value"), h.alias("h"))
    return out.select(*keys, "part_idx", "run", "line_no",
                      F.col("line").rlike(r"(?i)^\s*\[x\]").alias("correct"),
                      F.trim(F.when(has_sel | has_unsel, F.col("h.nothint")).otherwise(F.col("value"))).alias("text"),
                      F.when(has_sel, F.trim(sel)).alias("hint_selected"),
                      F.when(has_unsel, F.trim(unsel)).alias("hint_unselected"))


def compound_hints(lines: DataFrame, keys: list[str]) -> DataFrame:
    """TXT-6: ``{{ ((A*B)) hint }}`` lines of a checkbox group."""
    c = lines.filter(F.col("kind") == "compound")
    return c.select(*keys, "part_idx", "run", "line_no",
                    F.trim(F.regexp_extract(F.col("line"), RE_COMPOUND, 1)).alias("value"),
                    F.trim(F.replace(F.regexp_extract(F.col("line"), RE_COMPOUND, 2), F.lit("&lf;"), F.lit("\n")))
                    .alias("hint"))


def options_dropdown(parts: DataFrame, keys: list[str]) -> DataFrame:
    """TXT-7: ``[[a, (b), c]]`` on one line, or one option per line with hints."""
    body = _part_body(parts.filter(F.col("part").contains("[")))
    dd = body.select(*keys, "part_idx", F.posexplode("dropdowns").alias("dropdown", "raw"))
    inner = F.regexp_extract(F.col("raw"), RE_DROPDOWN, 1)
    one_line = ~F.col("raw").contains("\n")
    old = (dd.filter(one_line)
           .select(*keys, "part_idx", "dropdown",
                   F.posexplode(F.split(inner, r",\s*")).alias("option_idx", "opt")))
    old = old.select(*keys, "part_idx", "dropdown", "option_idx",
                     F.regexp_replace(F.col("opt"), r"^\s*\((.*?)\)\s*$", "$1").alias("text"),
                     F.col("opt").rlike(r"^\s*\((.*?)\)\s*$").alias("correct"),
                     F.lit("").alias("hint"), F.lit("").alias("hint_label"))
    new = (dd.filter(~one_line)
           .select(*keys, "part_idx", "dropdown",
                   F.filter(F.transform(F.split(inner, "\n"), lambda x: F.trim(x)), lambda x: x != "").alias("ls"))
           .select(*keys, "part_idx", "dropdown", F.posexplode("ls").alias("option_idx", "opt")))
    h = hint_parts(F.col("opt"))
    new = new.select(*keys, "part_idx", "dropdown", "option_idx", h.alias("h"))
    nh = F.col("h.nothint")
    parens = (F.length(nh) >= 2) & nh.startswith("(") & nh.endswith(")")
    new = new.select(*keys, "part_idx", "dropdown", "option_idx",
                     F.when(parens, F.expr("substring(h.nothint, 2, length(h.nothint) - 2)")).otherwise(nh).alias("text"),
                     parens.alias("correct"), F.col("h.hint").alias("hint"), F.col("h.label").alias("hint_label"))
    return old.unionByName(new)


def _answer_runs(lines: DataFrame, keys: list[str]) -> DataFrame:
    a = lines.filter(F.col("kind").isin("answer", "answer_more"))
    first = a.filter(F.col("kind") == "answer").select(
        *keys, "part_idx", "run", F.col("line").alias("first_line"))
    first_answer = F.regexp_replace(F.col("first_line"), r"^=\s*", "")
    rng = (F.substring(F.col("fa"), 1, 1).isin("[", "(") & F.substring(F.col("fa"), -1, 1).isin("]", ")"))
    return (first.withColumn("fa", first_answer)
            .withColumn("is_range", rng)
            .withColumn("is_numeric", F.col("fa").rlike(RE_NUMERIC) | F.col("is_range")))


def answers_numeric(lines: DataFrame, keys: list[str]) -> DataFrame:
    """TXT-8: numeric responses: answer (spaces removed), tolerance, range flag, extra answers.

    ``or=`` values count only when numeric and without range or tolerance.
    """
    runs = _answer_runs(lines, keys).filter("is_numeric")
    h = hint_parts(F.col("fa"))
    tol = F.regexp_extract(F.col("h.nothint"), r"(.*?)\+-\s*(.*?)$", 2)
    has_tol = F.col("h.nothint").rlike(r"(.*?)\+-\s*(.*?)$")
    ans = F.when(F.col("is_range"), F.col("h.nothint")).otherwise(
        F.regexp_replace(F.when(has_tol, F.regexp_extract(F.col("h.nothint"), r"(.*?)\+-\s*(.*?)$", 1))
                         .otherwise(F.col("h.nothint")), r"\s+", ""))
    base = runs.select(*keys, "part_idx", "run", "is_range", h.alias("h"), ans.alias("answer"),
                       F.when(~F.col("is_range") & has_tol, tol).alias("tolerance"))
    more = lines.filter(F.col("kind") == "answer_more")
    mh = hint_parts(F.col("line"))
    extra = (more.select(*keys, "part_idx", "run", "line_no", mh.alias("mh"))
             .withColumn("v", F.regexp_extract(F.col("mh.nothint"), r"^or=\s*(.*)", 1))
             .filter(F.col("mh.nothint").rlike(r"^or=") & F.col("v").rlike(RE_NUMERIC)
                     & ~(F.substring("v", 1, 1).isin("[", "(") & F.substring("v", -1, 1).isin("]", ")"))
                     & ~F.col("v").rlike(r"(.*?)\+-\s*(.*?)$"))
             .groupBy(*keys, "part_idx", "run")
             .agg(F.sort_array(F.collect_list(F.struct("line_no", "v"))).alias("xs")))
    return (base.join(extra, [*keys, "part_idx", "run"], "left")
            .select(*keys, "part_idx", "run", "answer", "tolerance", "is_range",
                    F.col("h.hint").alias("hint"),
                    F.coalesce(F.transform("xs", lambda x: x["v"]), F.array().cast("array<string>"))
                    .alias("additional_answers")))


def answers_string(lines: DataFrame, keys: list[str]) -> DataFrame:
    """TXT-9: string responses: answer, type (``ci`` or ``ci regexp``), ``or=`` answers, ``not=`` hints."""
    runs = _answer_runs(lines, keys).filter(~F.col("is_numeric"))
    fa = F.regexp_replace(F.col("first_line"), r"^s?=\s*", "")
    h = hint_parts(fa)
    is_re = F.col("h.nothint").startswith("|")
    base = runs.select(*keys, "part_idx", "run", h.alias("h"))
    base = base.select(*keys, "part_idx", "run",
                       F.when(is_re, F.trim(F.expr("substring(h.nothint, 2)"))).otherwise(F.col("h.nothint")).alias("answer"),
                       F.when(is_re, F.lit("ci regexp")).otherwise(F.lit("ci")).alias("match_type"),
                       F.col("h.hint").alias("hint"))
    more = lines.filter(F.col("kind") == "answer_more")
    mh = hint_parts(F.col("line"))
    m = more.select(*keys, "part_idx", "run", "line_no", mh.alias("mh"))
    ors = (m.filter(F.col("mh.nothint").rlike(r"^or="))
           .groupBy(*keys, "part_idx", "run")
           .agg(F.sort_array(F.collect_list(F.struct(
               "line_no", F.regexp_extract(F.col("mh.nothint"), r"^or=\s*(.*)", 1).alias("v")))).alias("ors")))
    nots = (m.filter(F.col("mh.nothint").rlike(r"^not="))
            .groupBy(*keys, "part_idx", "run")
            .agg(F.sort_array(F.collect_list(F.struct(
                "line_no", F.regexp_extract(F.col("mh.nothint"), r"^not=\s*(.*)", 1).alias("answer"),
                F.col("mh.hint").alias("hint")))).alias("nots")))
    return (base.join(ors, [*keys, "part_idx", "run"], "left").join(nots, [*keys, "part_idx", "run"], "left")
            .select(*keys, "part_idx", "run", "answer", "match_type", "hint",
                    F.coalesce(F.transform("ors", lambda x: x["v"]), F.array().cast("array<string>"))
                    .alias("additional_answers"),
                    F.coalesce(F.transform("nots", lambda x: F.struct(x["answer"].alias("answer"),
                                                                      x["hint"].alias("hint"))),
                               F.array().cast("array<struct<answer:string,hint:string>>")).alias("not_hints")))


# ---------------------------------------------------------------------------- records


class ParsedProblems:
    """All TXT tables of one docs frame; built lazily from the same parts/lines plans."""

    def __init__(self, docs: DataFrame, keys: list[str], stage=None):
        """``stage(name, df)`` may persist the parts and classified lines, which every
        extraction below reads."""
        stage = stage or (lambda name, df: df)
        self.keys = keys
        self.parts = stage("problem_parts", split_parts(docs, keys))
        self.lines = stage("problem_lines", problem_lines(self.parts, keys))
        self.labels = _unescaped(question_labels(self.parts, keys), "label", "description")
        self.hints = _unescaped(demand_hints(self.lines, keys), "hint")
        # code stays escaped in these two until their HTML has become Markdown (``records``)
        self._single = choices_single(self.lines, keys).unionByName(choices_single_multiline(self.parts, keys))
        self._multi = choices_multi(self.lines, keys)
        self.single = _unescaped(self._single, "text", "hint", "hint_label")
        self.multi = _unescaped(self._multi, "text", "hint_selected", "hint_unselected")
        self.compound = _unescaped(compound_hints(self.lines, keys), "hint")
        self.dropdowns = _unescaped(options_dropdown(self.parts, keys), "text", "hint", "hint_label")
        self.numeric = answers_numeric(self.lines, keys)
        self.string = _unescaped(answers_string(self.lines, keys), "answer", "hint")

    def elements(self) -> DataFrame:
        """What the records are made of, one row per label, demand hint, choice, answer and part: keys,
        ``part_idx``, ``kind`` (of the response for its rows), ``run``, ``at`` (position), ``text``,
        ``correct``, ``hint``, ``match_type``."""
        k = self.keys

        def rows(df: DataFrame, kind: str, run=None, at=None, text=None, correct=None, hint=None, match_type=None) -> DataFrame:
            made = {"run": (run, "bigint"), "at": (at, "int"), "text": (text, "string"), "correct": (correct, "boolean"),
                    "hint": (hint, "string"), "match_type": (match_type, "string")}
            return df.select(*k, "part_idx", F.lit(kind).alias("kind"),
                             *[(F.lit(None) if c is None else _c(c)).cast(t).alias(name) for name, (c, t) in made.items()])

        choice_hint = F.coalesce("hint_selected", "hint_unselected", F.lit(""))
        choices = (rows(self._single, SINGLE, "run", "line_no", "text", "correct", "hint")
                   .unionByName(rows(self._multi, MULTI, "run", "line_no", "text", "correct", choice_hint)))
        choices = choices.withColumns({"text": _choice_markdown("text"), "hint": _choice_markdown("hint")})
        return (choices.unionByName(rows(self.string, STRING, "run", text="answer", match_type="match_type"))
                .unionByName(rows(self.numeric, "numericalresponse", "run"))
                .unionByName(rows(self.dropdowns, "optionresponse", "dropdown"))
                .unionByName(rows(self.labels, "label", at="label_idx", text="label"))
                .unionByName(rows(self.hints, "demand_hint", at="line_no", text="hint"))
                .unionByName(rows(self.parts, "part")))

    def records(self) -> DataFrame:
        """TXT-13: one row per document: kind, question type, label, answer, hint, choices."""
        return self.keyed_records().drop("_key")

    def keyed_records(self) -> DataFrame:
        """``records`` with the hash of their keys. The elements are dealt by document once; parts are
        summed up first, then documents."""
        from lectern.functions.text import question_type
        k, kind, at = self.keys, F.col("kind"), F.col("at")
        of = lambda value, *kinds: F.when(kind.isin(*kinds), value)
        # lines of one run, a part's multi-line choices (run -1) and the options of a dropdown are one
        # response; each answer is one
        several = F.size(F.collect_set(of(F.struct("kind", "run"), SINGLE, MULTI, "optionresponse")))
        choice = F.struct("part_idx", at.alias("line_no"), "text", "correct", "hint")
        parts = keyed(self.elements(), k).repartition("_key").groupBy("_key", *k, "part_idx").agg(
            (several + F.count(of(F.lit(1), STRING, "numericalresponse"))).alias("n_resp"),
            F.max(of(kind, SINGLE, MULTI, STRING, "numericalresponse", "optionresponse")).alias("only"),
            *[F.max(kind == name).alias(f"has_{name}") for name in (SINGLE, MULTI, STRING)],
            F.max_by("text", of(at, "label")).alias("part_label"),
            F.max_by("text", of(at, "demand_hint")).alias("hint"), F.max(of(at, "demand_hint")).alias("hint_at"),
            F.collect_list(of(choice, SINGLE)).alias("sc"), F.collect_list(of(choice, MULTI)).alias("mc"),
            F.max_by(F.struct(F.col("text").alias("answer"), "match_type"), of(F.col("run"), STRING)).alias("sa"))
        # if a part holds exactly one response, its label belongs to it
        own = lambda name: F.max_by("part_label", F.when((F.col("n_resp") == 1) & (F.col("only") == name)
                                                         & F.col("part_label").isNotNull(), F.col("part_idx")))
        has = lambda name: F.col(f"has_{name}")
        docs = parts.groupBy("_key", *k).agg(
            *[F.max(has(name)).alias(f"has_{name}") for name in (SINGLE, MULTI, STRING)],
            *[own(name).alias(f"label_{name}") for name in (SINGLE, MULTI, STRING)],
            F.max_by("hint", F.when(F.col("hint_at").isNotNull(), F.col("part_idx"))).alias("demand_hint"),
            F.sort_array(F.flatten(F.collect_list("sc"))).alias("sc"), F.sort_array(F.flatten(F.collect_list("mc"))).alias("mc"),
            F.max_by("sa", F.when(has(STRING), F.col("part_idx"))).alias("sa"))
        # kinds are chosen single → checkbox → string
        chosen = lambda single, multi, string: F.when(has(SINGLE), single).when(has(MULTI), multi).when(has(STRING), string)
        kind = chosen(*[F.lit(name) for name in (SINGLE, MULTI, STRING)])
        label = chosen(*[F.col(f"label_{name}") for name in (SINGLE, MULTI, STRING)])
        none = F.lit(None)
        choices = chosen(F.col("sc"), F.col("mc"), none)
        return docs.select(
            "_key", *k, kind.alias("kind"), question_type(kind).alias("question_type"),
            F.coalesce(label, F.lit("")).alias("label"),
            chosen(none, none, F.col("sa.answer")).alias("answer"),
            chosen(none, none, F.col("sa.match_type")).alias("match_type"),
            F.col("demand_hint"),
            F.transform(choices, lambda c: F.struct(c["text"].alias("text"), c["correct"].alias("correct"),
                                                    c["hint"].alias("hint"))).alias("choices"))


def question_choices(records: DataFrame, keys: list[str]) -> DataFrame:
    """TXT-14 + WIN-4: one row per answer choice: seq = (position+1)*10, Markdown text without
    hint markup, explanation = the choice's first hint (both converted by ``records``)."""
    ch = records.select(*keys, F.posexplode("choices").alias("pos", "c"))
    return ch.select(*keys, ((F.col("pos") + 1) * 10).alias("seq"),
                     F.trim(strip_hints(F.col("c.text"))).alias("text"),
                     F.col("c.correct").alias("is_answer"),
                     F.col("c.hint").alias("explanation"))
