"""Top-level declarations of a Rust text, as one expression per file row.

One regex cuts a text into tokens that end at a statement boundary: a semicolon, a whole
brace group, or a whole attribute.  Round and square groups are swallowed on the way.  A
fold over these few tokens joins what belongs together (``const X: T = { .. };``), counts
lines, and follows the depth where brackets nest too deep for the regex; further regexes
on the segment heads classify and name them; a second fold over an impl block's header counts
angle brackets to find its trait and type.  Comments inside comments, which no regex can count,
are hidden from the first one by a fold over the signs of comments and literals, in files that
have any.  All of it stays inside the file's row: no token table, no shuffle, and no key to be
skewed.

Known limit: unbalanced brackets (broken source).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.config import ITEM_NAME_CHARS, LARGE_IMPL_LINES
from corpusloom.functions.text import (
    count_newlines,
    folded,
    gather,
    is_blank,
    let,
    split_lines,
    trim_all,
    unix_newlines,
)

_BRACKET_NESTING = 16  # groups that nest deeper are followed by the fold: slower, not different

_COMMENT = r"//[^\n]*+|/\*(?:[^*]++|\*(?!/))*+\*/"  # those inside others are hidden
_SHEBANG = r"\A#!(?!\s*\[)[^\n]*+"
_ATTRIBUTE = r"#\s*+!?\s*+\["


def _plain(tag: str, besides: str = "") -> str:
    """One piece of text without brackets, semicolons and the signs ``besides``; ``tag`` keeps
    group names apart.

    Possessive throughout: Java recurses on backtracking loops over long inputs.
    """
    raw = r"(?<=(?<!\w)[bc]?r)"
    return "|".join(
        [
            rf"[^{{}}()\[\];\"'/#{besides}]++",
            rf'{raw}".*?"',
            r'"[^"\\]*+(?:\\.[^"\\]*+)*+"',
            rf'{raw}(?<{tag}>#++)".*?"\k<{tag}>',
            r"'(?:\\(?:u\{[^}]*+\}|x..|.)|[^'\\\n])'",  # character, before lifetimes
            _COMMENT,
            r"[\"'/]",
        ]
    )


def _inside(levels: int) -> str:
    """Anything balanced between two brackets, up to ``levels`` further levels."""
    group = rf"|[{{(\[]{_inside(levels - 1)}[}})\]]" if levels else ""
    return rf"(?:{_plain(f'n{levels}')}|[;#]{group})*+"


_INSIDE = _inside(_BRACKET_NESTING)


def _run(tag: str) -> str:
    """Text up to a boundary; a brace group between ``<`` ``,`` ``=`` and ``>`` ``,`` is a
    generic argument, whatever blanks and comments stand beside it."""
    # The nested patterns carry named groups, so each use renames them.
    inside = [_INSIDE.replace("<n", f"<{tag}{use}n") for use in "abc"]
    gap = rf"(?:\s|{_COMMENT})*+"
    return (
        rf"(?:{_SHEBANG}|[<,=]{gap}\{{{inside[2]}\}}(?={gap}[>,])|[<,=]|{_plain(tag, '<,=')}"
        rf"|#(?!\s*+!?\s*+\[)|\({inside[0]}\)|\[{inside[1]}\])"
    )


_BOUNDARY = rf"(?:\{{{_INSIDE.replace('<n', '<bn')}\}}|;|{_ATTRIBUTE}{_INSIDE.replace('<n', '<an')}\])"
_TOKEN = rf"(?s){_run('x')}*+{_BOUNDARY}|{_run('y')}++|{_ATTRIBUTE}|[{{}}()\[\]]"
_ENDS_IN_ATTRIBUTE = rf"(?s)\A{_run('x')}*+{_ATTRIBUTE}"
_TO_BODY = rf"(?s)\A{_run('x')}*+\{{"

_TRIVIA = rf"(?s)\A(?:\s++|{_SHEBANG}|{_COMMENT})*+"
_GAP = rf"(?:\s|{_COMMENT})"
_VISIBILITY = rf"(?:pub\b{_GAP}*+(?:\([^)]*\){_GAP}*+)?)?"
_NAME = r"((?:r#)?\w+)"
_LEAD = rf"(?Us)\A(?:{_GAP}|{_SHEBANG})*+{_VISIBILITY}"
_CONST = rf"{_LEAD}(?:default{_GAP}++)?const{_GAP}++(?!(?:fn|unsafe|async|extern)\b){_NAME}{_GAP}*+:"
_MACRO = rf"{_LEAD}macro_rules!{_GAP}*+{_NAME}"
_MODIFIER = rf'(?:default|async|unsafe|const|auto|gen|safe|extern(?:{_GAP}*+"[^"]*")?){_GAP}++'
_ITEM = (
    rf"{_LEAD}(?:{_MODIFIER})*(fn|struct|enum|impl|trait|mod|static|type)\b"
    rf"(?:{_GAP}++(?:(?:mut|ref){_GAP}++)*+{_NAME})?"
)
# Statements whose braces belong to a value or a list: they end at a semicolon only.
_TO_SEMICOLON = (
    rf"{_LEAD}(?:default{_GAP}++)?"
    rf"(?:use|static|type|extern{_GAP}++crate|const(?!{_GAP}++(?:fn|unsafe|async|extern)\b))\b"
)
# Lexemes of an impl header; and of a text, as far as comments and literals go.
_HEADER = (
    rf"(?s){_COMMENT}|\s++|[-=]>|::|(?<=(?<!\w)[bc]?r)(#*+)\".*?\"\1|\"[^\"\\]*+(?:\\.[^\"\\]*+)*+\""
    r"|'(?:\\(?:u\{[^}]*+\}|x..|.)|[^'\\\n])'|'\w++|(?:r#)?\w++|."
)
_SIGNS = r"""(?s)'(?:"|\\"|\\\\)'|\\(?:\\|"#*+)|(?<!\w)[bc]?r#*+"#*+|"#*+|[/*\n]|\w++|[^\w/*\n"\\']++|."""
# Characters that stand for the star of a hidden comment sign: the first that the text does not hold.
_MARKS = [chr(c) for c in range(0xFDD0, 0xFDF0)]

_ENDS_BY_BRACE = ["fn", "enum", "trait"]
_ENDS_BY_SEMICOLON = ["const", "static", "type"]
_MEMBER_KINDS = ["fn", "const", "type"]

# Token codes: how a token ends.
_OTHER, _OPENS, _OPENS_ATTRIBUTE, _STATEMENT, _GROUP, _ATTRIBUTE_GROUP = 0, 1, 2, 3, 4, 5
_CLOSES, _CLOSES_BRACE, _CLOSES_SQUARE = -1, -2, -3
_SEGMENT = "struct<first:int,last:int,start_line:int,end_line:int>"


def tokens(source: Column) -> Column:
    """Statement-sized tokens; joined they are the source plus one final newline.

    That newline makes the last token end in no boundary, whatever the file ends with.
    """
    return F.regexp_extract_all(F.concat(source, F.lit("\n")), F.lit(_TOKEN), 0)


def _trivia(token: Column) -> Column:
    return F.regexp_extract(token, _TRIVIA, 0)


def _with_codes(toks: Column) -> Column:
    """Per token how it ends and how many lines it spans, so that the fold only compares."""

    def coded(t: Column) -> Column:
        code = (
            F.when(F.endswith(t, F.lit("}")), F.when(t == "}", _CLOSES_BRACE).otherwise(_GROUP))
            .when(F.endswith(t, F.lit(";")), _STATEMENT)
            .when(
                F.endswith(t, F.lit("]")),
                F.when(t == "]", _CLOSES_SQUARE)
                .when(F.rlike(t, F.lit(_ENDS_IN_ATTRIBUTE)), _ATTRIBUTE_GROUP)
                .otherwise(_OTHER),
            )
            .when(t == ")", _CLOSES)
            .when(t.isin("{", "(", "["), _OPENS)
            .when(F.rlike(t, F.lit(rf"\A{_ATTRIBUTE}\z")), _OPENS_ATTRIBUTE)
            .otherwise(_OTHER)
        )
        return F.struct(code.alias("code"), count_newlines(t).cast("int").alias("newlines"))

    return F.transform(toks, coded)


def _segments(toks: Column, start_line: Column) -> Column:
    """Cut tokens into statements; positions are 0-based, ``first`` and ``last`` inclusive.

    Brackets that stand alone as a token opened or closed a group the regex could not
    take whole; ``depth`` follows those.
    """
    start = F.struct(
        F.lit(0).alias("i"),
        F.lit(0).alias("depth"),
        start_line.cast("int").alias("line"),
        F.lit(-1).alias("first"),
        F.lit(0).alias("first_line"),
        F.lit(False).alias("in_attribute"),
    )

    def step(acc: Column, tok: Column) -> tuple[Column, Column, Column]:
        """The next state, whether a segment ends here, and that segment."""
        i, depth, code = acc["i"], acc["depth"], tok["code"]
        opens = code.isin(_OPENS, _OPENS_ATTRIBUTE)
        after = (
            F.when(opens, depth + 1).when(code < 0, F.greatest(depth - 1, F.lit(0))).otherwise(depth)
        )
        begins = acc["first"] < 0
        first = F.when(begins, i).otherwise(acc["first"])
        first_line = F.when(
            begins, acc["line"] + count_newlines(_trivia(F.get(toks, i)))
        ).otherwise(acc["first_line"])
        line = acc["line"] + tok["newlines"]
        is_value = F.rlike(F.get(toks, first), F.lit(_TO_SEMICOLON))
        ends = (
            F.when(after > 0, False)
            .when(code.isin(_STATEMENT, _ATTRIBUTE_GROUP), True)
            .when(code.isin(_GROUP, _CLOSES_BRACE), ~is_value)
            .when(code == _CLOSES_SQUARE, acc["in_attribute"])
            .otherwise(False)
        )
        state = F.struct(
            (i + 1).alias("i"),
            after.alias("depth"),
            line.alias("line"),
            F.when(ends, -1).otherwise(first).alias("first"),
            first_line.cast("int").alias("first_line"),
            F.when(opens & (depth == 0), code == _OPENS_ATTRIBUTE)
            .otherwise(acc["in_attribute"])
            .alias("in_attribute"),
        )
        return state, ends, F.struct(first, i, first_line, line).cast(_SEGMENT)

    return let(_with_codes(toks), lambda codes: folded(codes, start, step, _SEGMENT))


def _classified(toks: Column, segments: Column) -> Column:
    """Segments that are declarations, with kind, name, text and line coverage."""

    def with_kind(seg: Column) -> Column:
        head = F.get(toks, seg["first"])
        kind = (
            F.when(F.rlike(head, F.lit(_CONST)), "const")
            .when(F.rlike(head, F.lit(_MACRO)), "macro")
            .otherwise(F.regexp_extract(head, _ITEM, 1))
        )
        return F.struct(seg.alias("seg"), kind.alias("kind"))

    def with_text(part: Column) -> Column:
        seg, kind = part["seg"], part["kind"]
        head = F.get(toks, seg["first"])
        name = (
            F.when(kind == "impl", "")
            .when(kind == "const", F.regexp_extract(head, _CONST, 1))
            .when(kind == "macro", F.regexp_extract(head, _MACRO, 1))
            .otherwise(F.regexp_extract(head, _ITEM, 2))
        )
        trivia = _trivia(head)
        text = F.array_join(gather(toks, seg["first"], seg["last"]), "")
        at_line_start = F.when(trivia == "", seg["first"] == 0).otherwise(
            F.endswith(trivia, F.lit("\n"))
        )
        at_line_end = F.rlike(F.get(toks, seg["last"] + 1), F.lit(r"\A\r?\n"))
        start, end = seg["start_line"], seg["end_line"]
        return F.struct(
            kind.alias("kind"),
            name.alias("name"),
            start.alias("start_line"),
            end.alias("end_line"),
            F.substr(text, F.length(trivia) + 1).alias("text"),
            # lines that lie wholly inside the item
            F.when(at_line_start, start).otherwise(start + 1).alias("covers_from"),
            F.when(at_line_end, end).otherwise(end - 1).alias("covers_to"),
        )

    def is_item(item: Column) -> Column:
        # A bodiless fn is only a signature, a type without a value only a requirement.
        by_brace = F.endswith(item["text"], F.lit("}"))
        return (
            F.when(item["kind"].isin(_ENDS_BY_BRACE), by_brace)
            .when(item["kind"] == "type", ~by_brace & F.contains(item["text"], F.lit("=")))
            .when(item["kind"].isin(_ENDS_BY_SEMICOLON), ~by_brace)
            .otherwise(True)
        )

    named = F.filter(F.transform(segments, with_kind), lambda part: part["kind"] != "")
    return F.filter(F.transform(named, with_text), is_item)


def _piece(item: Column, name: Column, whole_lines: bool) -> Column:
    return F.struct(
        F.struct(
            item["start_line"].cast("long").alias("start_line"),
            item["end_line"].cast("long").alias("end_line"),
            name.alias("item_name"),
            item["text"].alias("text"),
        ).alias("chunk"),
        item["start_line" if whole_lines else "covers_from"].alias("covers_from"),
        item["end_line" if whole_lines else "covers_to"].alias("covers_to"),
    )


def item_name(item: Column) -> Column:
    """The declared name, or else the first line, trimmed, at most 60 characters."""
    first_line = F.substring_index(unix_newlines(item["text"]), "\n", 1)
    return F.when(item["name"] != "", item["name"]).otherwise(
        F.left(trim_all(first_line), F.lit(ITEM_NAME_CHARS))
    )


def _header_parts(header: Column) -> Column:
    """Where, in an impl header that ends in its brace, the trait and the type begin and end.

    Follows angle brackets and, apart from them, all others.  A list right behind ``impl`` holds
    the generics, unless ``::`` follows: then it begins a path.  The first ``for`` behind a
    finished path separates trait and type (others bind lifetimes); ``where`` ends the type.
    Positions count characters from 0; -1: not met.
    """
    counts = dict.fromkeys(("at", "angle", "other", "done"), 0)
    places = dict.fromkeys(("list_from", "from", "to", "for_at", "type_from", "end"), -1)
    start = F.struct(*[F.lit(v).alias(n) for n, v in {**counts, **places, "before": ""}.items()])

    def step(acc: Column, lex: Column) -> Column:
        trivia = F.rlike(lex, F.lit(r"\A(?:\s|//|/\*)"))
        flat = (acc["angle"] == 0) & (acc["other"] == 0)
        begins, last = acc["from"] < 0, acc["before"]
        end = acc["at"] + F.length(lex)
        angle = F.when(acc["other"] > 0, acc["angle"]).when(lex == "<", acc["angle"] + 1)
        angle = angle.when(lex == ">", F.greatest(acc["angle"] - 1, F.lit(0))).otherwise(acc["angle"])
        other = F.when(lex.isin("(", "[", "{"), acc["other"] + 1).when(lex.isin(")", "]", "}"), acc["other"] - 1).otherwise(acc["other"])
        # generics: from the list's bracket to what follows it
        opens_list = begins & (last == "impl") & (lex == "<")
        in_list = begins & (acc["list_from"] >= 0) & ((acc["angle"] > 0) | (acc["other"] > 0))
        behind_list = begins & (acc["list_from"] >= 0) & flat
        lead = (
            (lex.isin("default", "unsafe", "impl") & last.isin("", "default", "unsafe"))
            | ((lex == "const") & last.isin("impl", ">"))
            | (lex == "!")
        )
        starts = begins & flat & ~opens_list & ~lead
        subject = F.when(~starts, acc["from"]).when(behind_list & (lex == "::"), acc["list_from"]).otherwise(acc["at"])
        path_ended = F.rlike(last, F.lit(r"[\w>)\]}]\z")) & ~last.isin("dyn", "impl", "mut", "const", "for")
        parts = flat & ~begins & (lex == "for") & (acc["for_at"] < 0) & path_ended
        stops = flat & ~begins & (lex == "where")
        told = ~trivia & (acc["done"] == 0)
        values = {
            "at": end,
            "angle": F.when(trivia, acc["angle"]).otherwise(angle),
            "other": F.when(trivia, acc["other"]).otherwise(other),
            "before": F.when(trivia, last).otherwise(lex),
            "list_from": F.when(told & opens_list, acc["at"]).otherwise(acc["list_from"]),
            "from": F.when(told & ~in_list, subject).otherwise(acc["from"]),
            "to": F.when(told & parts, acc["end"]).otherwise(acc["to"]),
            "for_at": F.when(told & parts, acc["at"]).otherwise(acc["for_at"]),
            "type_from": F.when(told & (acc["for_at"] >= 0) & (acc["type_from"] < 0), acc["at"]).otherwise(acc["type_from"]),
            "done": F.when(told & stops, 1).otherwise(acc["done"]),
            "end": F.when(told & ~stops, end).otherwise(acc["end"]),
        }
        return F.struct(*[values[n].cast("string" if n == "before" else "int").alias(n) for n in (*counts, *places, "before")])

    return F.aggregate(F.regexp_extract_all(header, F.lit(_HEADER), 0), start, step)


def impl_name(header: Column) -> Column:
    """``Type`` or ``Type<Trait>`` from an impl header that ends in its brace."""

    def between(a: Column, b: Column) -> Column:
        return F.substr(open_, a + 1, F.greatest(b - a, F.lit(0)))

    open_ = F.substr(header, F.lit(1), F.greatest(F.length(header) - 1, F.lit(0)))

    def of_parts(p: Column) -> Column:
        separate = (p["for_at"] >= 0) & (p["type_from"] >= 0)
        return (
            F.when(p["from"] < 0, "impl")
            .when(separate, F.concat(between(p["type_from"], p["end"]), F.lit("<"), between(p["from"], p["to"]), F.lit(">")))
            .otherwise(between(p["from"], p["end"]))
        )

    return let(_header_parts(open_), of_parts)


def _impl_pieces(item: Column) -> Column:
    """A large impl block: one piece per member, or the whole block if it has none."""

    def of_parts(parts: Column) -> Column:
        header, name = parts["header"], parts["name"]
        body = F.substr(item["text"], F.length(header) + 1)
        lead = item["start_line"] + count_newlines(header)

        def member(m: Column) -> Column:
            own = F.when(m["name"] != "", m["name"]).otherwise("unknown")
            return _piece(m, F.concat(name, F.lit("::"), own), whole_lines=True)

        def of_tokens(toks: Column) -> Column:
            members = F.filter(
                _classified(toks, _segments(toks, lead)), lambda m: m["kind"].isin(_MEMBER_KINDS)
            )
            return F.transform(members, member)

        whole = F.array(_piece(item, name, whole_lines=True))
        # The impl's own closing brace is the last character of the body.
        inner = F.substr(body, F.lit(1), F.length(body) - 1)
        return let(
            let(tokens(inner), of_tokens), lambda ms: F.when(F.size(ms) > 0, ms).otherwise(whole)
        )

    header = F.regexp_extract(item["text"], _TO_BODY, 0)
    return let(
        let(header, lambda h: F.struct(h.alias("header"), impl_name(h).alias("name"))), of_parts
    )


def _pieces(toks: Column) -> Column:
    def of_item(item: Column) -> Column:
        large = (item["kind"] == "impl") & (
            item["end_line"] - item["start_line"] + 1 > LARGE_IMPL_LINES
        )
        return F.when(large, _impl_pieces(item)).otherwise(
            F.array(_piece(item, item_name(item), whole_lines=False))
        )

    return F.flatten(F.transform(_classified(toks, _segments(toks, F.lit(1))), of_item))


def _preamble(lines: Column, pieces: Column) -> Column:
    """Non-blank lines that lie in no single piece, as zero or one chunk."""
    covered = F.flatten(
        F.transform(
            F.filter(pieces, lambda p: p["covers_from"] <= p["covers_to"]),
            lambda p: F.sequence(p["covers_from"], p["covers_to"]),
        )
    )
    every = F.when(F.size(lines) > 0, F.sequence(F.lit(1), F.size(lines))).otherwise(
        F.array().cast("array<int>")
    )
    left = F.filter(F.array_except(every, covered), lambda n: ~is_blank(F.get(lines, n - 1)))

    def of_left(left: Column) -> Column:
        chunk = F.struct(
            F.get(left, F.lit(0)).cast("long").alias("start_line"),
            F.get(left, F.size(left) - 1).cast("long").alias("end_line"),
            F.lit("preamble").alias("item_name"),
            F.array_join(F.transform(left, lambda n: F.get(lines, n - 1)), "\n").alias("text"),
        )
        return F.slice(F.array(chunk), 1, F.least(F.size(left), F.lit(1)))

    return let(left, of_left)


def _has_nested_comments(source: Column) -> Column:
    """Whether a comment may hold another: never missed, at times seen where there is none."""
    signs = F.regexp_extract_all(source, F.lit(r"/\*|\*/(?!\*)"), F.lit(0))
    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("nested"))

    def step(acc: Column, sign: Column) -> Column:
        depth = F.when(sign == "/*", acc["depth"] + 1).otherwise(F.greatest(acc["depth"] - 1, F.lit(0)))
        return F.struct(depth.alias("depth"), (acc["nested"] | (depth > 1)).alias("nested"))

    return F.aggregate(signs, start, step, lambda acc: acc["nested"])


def _hide_nested(source: Column, mark: Column) -> Column:
    """``source`` with the stars of the signs of comments inside comments replaced by ``mark``.

    Modes: 0 code, n > 0 inside n comments, -1 a line comment, -2 a string, -10 - n a raw string
    of n hashes.  A sign of a comment is two neighbouring lexemes, so ``/*/`` opens one.
    """
    start = F.struct(F.lit(0).alias("mode"), F.lit("").alias("before"))

    def step(acc: Column, item: Column) -> tuple[Column, Column, Column]:
        mode, before, lex = acc["mode"], acc["before"], item["lex"]
        quote = F.contains(lex, F.lit('"'))
        slash = F.contains(lex, F.lit("\\"))
        raw = F.rlike(lex, F.lit('\\A[bc]?r#*"'))
        ahead = F.length(F.regexp_extract(lex, '\\A[bc]?r(#*)"', 1))
        behind = F.length(F.regexp_extract(lex, "\"(#*)'?\\z", 1))
        opens = (before == "/") & (lex == "*") & (mode >= 0)
        closes = (before == "*") & (lex == "/") & (mode > 0)
        after = (
            F.when(opens, mode + 1)
            .when(closes, mode - 1)
            .when(mode > 0, mode)
            .when(mode == -1, F.when(lex == "\n", 0).otherwise(-1))
            .when(mode == -2, F.when(quote & ~slash, 0).otherwise(-2))
            .when(mode < -2, F.when(quote & (behind >= -10 - mode), 0).otherwise(mode))
            .when((before == "/") & (lex == "/"), -1)
            .when(raw, -10 - ahead)
            .when(quote & ~slash & ~F.startswith(lex, F.lit("'")), -2)
            .otherwise(0)
        )
        sign = lex.isin("/", "*") & ~opens & ~closes
        hidden = (lex == "*") & F.when(opens, mode >= 1).otherwise((mode >= 2) & (item["next"] == "/"))
        state = F.struct(after.cast("int").alias("mode"), F.when(sign, lex).otherwise("").alias("before"))
        return state, F.lit(True), F.when(hidden, mark).otherwise(lex)

    def of_lexemes(lexemes: Column) -> Column:
        place = lambda lex, i: F.struct(lex.alias("lex"), F.coalesce(F.get(lexemes, i + 1), F.lit("")).alias("next"))
        return let(F.transform(lexemes, place), lambda items: F.array_join(folded(items, start, step, "string"), ""))

    return let(F.regexp_extract_all(source, F.lit(_SIGNS), F.lit(0)), of_lexemes)


def cuttable(source: Column) -> Column:
    """``text`` and ``mark``: the text with the signs of comments inside comments hidden behind a
    character, and that character; the text as it is and null where there are none."""
    free = F.filter(F.array(*map(F.lit, _MARKS)), lambda c: ~F.contains(source, c))
    mark = F.when(_has_nested_comments(source), F.get(free, F.lit(0)))

    def of_mark(mark: Column) -> Column:
        text = F.when(mark.isNull(), source).otherwise(_hide_nested(source, mark))
        return F.struct(text.alias("text"), mark.alias("mark"))

    return F.when(F.contains(source, F.lit("/*")), let(mark, of_mark)).otherwise(
        F.struct(source.alias("text"), F.lit(None).cast("string").alias("mark"))
    )


def declaration_chunks(source: Column, plain: Column) -> Column:
    """``array<struct<start_line, end_line, item_name, text>>``, preamble first; ``plain`` is
    ``cuttable(source)``, a column of its own since Spark resolves nested lambdas level by level."""

    def shown(piece: Column) -> Column:
        chunk, mark = piece["chunk"], plain["mark"]
        own = [F.when(mark.isNull(), chunk[n]).otherwise(F.replace(chunk[n], mark, F.lit("*"))).alias(n) for n in ("item_name", "text")]
        return F.struct(chunk["start_line"], chunk["end_line"], *own)

    return let(
        let(tokens(plain["text"]), _pieces),
        lambda pieces: F.concat(
            let(split_lines(source), lambda lines: _preamble(lines, pieces)),
            F.transform(pieces, shown),
        ),
    )
