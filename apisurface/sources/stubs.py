"""Stub texts (``.pyi``) as rows: one for each function that a module or class body defines.

A text whose brackets match is cut into statements, each with its decorators, by one regular expression; another spaces out the signatures
that are made of names, numbers, plain strings and signs. Any other text is cut into lines: running sums over the lines of a file give the
number and bracket depth of each, a line end outside of brackets closes a statement. Any other signature is cut into tokens. What
encloses a statement follows from indentation: for each width the last statement indented no further is remembered, and those of smaller width are its openers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from apisurface.functions.types import let
from apisurface.session import cut_lineage, sized

_LONG = '"""[^"\\\\]*+(?:(?:\\\\.|"(?!""))[^"\\\\]*+)*+"""|\'\'\'[^\'\\\\]*+(?:(?:\\\\.|\'(?!\'\'))[^\'\\\\]*+)*+\'\'\''
_SHORT = '"[^"\\\\\\n]*+(?:\\\\.[^"\\\\\\n]*+)*+"|\'[^\'\\\\\\n]*+(?:\\\\.[^\'\\\\\\n]*+)*+\''
_TRIPLE = f"[rRbBuUfF]{{0,2}}(?:{_LONG})"
_QUOTED = f"[rRbBuUfF]{{0,2}}(?:{_SHORT})"
_COMMENT = "#[^\\n]*+"
_BREAK = "\\\\?\\r?\\n"
_BLANKS = "[ \\t\\f\\r]++"
_NUMBER = "\\.?\\d(?:[eE][+-]|[\\w.])*+"
_WORD = "[\\p{L}_][\\p{L}\\p{M}\\p{N}_]*+"
_SIGNS = "->|\\*\\*|//|<<|>>|[=!<>:]=|\\.\\.\\.|."
TOKEN = f"(?s){_TRIPLE}|{_QUOTED}|{_COMMENT}|{_BREAK}|{_BLANKS}|{_NUMBER}|{_WORD}|{_SIGNS}"
#: Blanks, comments and line ends between tokens.
_SKIPPED = f"(?:{_BLANKS}|{_COMMENT}|{_BREAK})*+"
_IN_LINE = f"(?:[^\\n\"'#\\\\]++|{_TRIPLE}|{_QUOTED}|{_COMMENT}|\\\\\\r?\\n|[^\\n])"
#: A line with the strings over several lines and joined lines in it.
LINE = f"(?s){_IN_LINE}*+\\n|{_IN_LINE}++"
#: A tab reaches to the next multiple of so many columns; as indentation mixes seldom, each counts in full.
TAB = 8
#: Words behind which a sign is no second operand's.
_LEADING_WORDS = ("lambda", "if", "else", "not", "and", "or", "in", "is", "await", "return")
_SPACED = ("|", "+", "-", "*", "/", "//", "%", "@", "&", "^", "<<", ">>", "==", "!=", "<", ">", "<=", ">=", "**", "->", ":=")

#: Brackets within brackets that one expression follows; texts with more are cut into lines.
NESTED = 8
_IN_WORD = "\\p{L}\\p{M}\\p{N}_"
_PLAIN = "[^\"'#\\\\()\\[\\]{}]++"
_JOINED = "\\\\\\r?\\n"
_GAP = f"(?:{_BLANKS}|{_JOINED})*+"


def _brackets(levels: int) -> str:
    """A pair of brackets of any kind and what it holds."""
    inner = f"|{_brackets(levels - 1)}" if levels > 1 else ""
    return f"[(\\[{{](?:{_PLAIN}|{_LONG}|{_SHORT}|{_COMMENT}|[\"'\\\\]{inner})*+[)\\]}}]"


_PAIR = _brackets(NESTED)
_STATEMENT = f"(?:[^\\n\"'#\\\\()\\[\\]{{}}]++|{_LONG}|{_SHORT}|{_COMMENT}|{_JOINED}|{_PAIR}|[\"'\\\\])*+\\n"
_BLANK_LINE = f"(?:{_BLANKS}|{_COMMENT}|{_JOINED})*+\\n"
_DECORATOR = f"{_GAP}@{_STATEMENT}"
_BEFORE = f"(?:{_BLANK_LINE}|{_DECORATOR})"
#: A statement with the blank lines and decorators before it, or those at the end of a text. Each begins where the last one ended.
UNIT = f"(?s)\\G(?:{_BEFORE}*+{_STATEMENT}|{_BEFORE}++)"
_KEY = f"(?s)^{_GAP}(class|(?:async(?![{_IN_WORD}]){_SKIPPED})?def)(?![{_IN_WORD}])"
_NAME = f"{_KEY}{_SKIPPED}({_TRIPLE}|{_QUOTED}|{_NUMBER}|{_WORD}|{_SIGNS})"
#: A signature: what comes before the colon outside of brackets.
_SIGNATURE = f"(?s)^{_GAP}((?:[^:\"'#\\\\()\\[\\]{{}}]++|{_LONG}|{_SHORT}|{_COMMENT}|{_PAIR}|:=|[\"'\\\\])*+)"

_SPACE = "[ \\t\\f\\r\\n]"
_SPACES = f"(?:{_SPACE}++|{_COMMENT})"
_BARE_STRING = "'[^'\\\\\\n]*+'|\"[^\"\\\\\\n]*+\""
_ONE_SIGN = "|".join(f"{a}(?!{_SPACES}*+[{b}])" for a, b in ((",", ","), (":", "="), ("=", "="), ("-", ">"), ("\\*", "*"), ("/", "/"), ("<", "<="), (">", ">=")))
#: Names, numbers, strings without a backslash and signs that stay what they are when the blanks between them go.
_SIMPLE = (
    f"(?s)^(?:(?=[\\p{{L}}_])(?!(?=[{''.join(sorted({w[0] for w in _LEADING_WORDS}))}])(?:{'|'.join(_LEADING_WORDS)})(?![{_IN_WORD}])){_WORD}"
    f"(?:(?=[()\\[\\],.:=|])|(?=[^{_IN_WORD} \\t\\f\\r\\n#\"'])|(?= [\\p{{L}}\\p{{N}}_])|(?!{_SPACES}*+[{_IN_WORD}\"']))"
    f"|[,:=] ?+(?=[^,=# \\t\\f\\r\\n])|\\.?\\d[\\w.]*+(?!(?<=[eE])[+-])(?!{_SPACES}*+[{_IN_WORD}\"'.])|[()\\[\\]{{}}|.+%@&^~ \\t\\f\\r\\n]++"
    f"|->|\\*\\*|//|<<|>>|[=!<>]=|{_ONE_SIGN}|\"[^\"\\\\\\n]*+\"(?!\")|'[^'\\\\\\n]*+'(?!')|{_COMMENT})*+\\z"
)
#: Blanks and comments, but for those between two words. This expression and those below look first for the characters they can begin with.
_LOOSE = f"(?=[^{_IN_WORD}])(?:({_BARE_STRING}){_SPACES}*+|([^ \\t\\f\\r\\n\"'#]){_SPACES}++|{_SPACES}++(?![{_IN_WORD}])|^{_SPACES}++)"
#: A comma before a closing bracket, but for that of a tuple of one.
_LAST_COMMA = (
    f"(?=[(,'\"])(?:({_BARE_STRING})|(\\((?:{_BARE_STRING}|\\.?\\d[\\w.]*+|{_WORD}|->|\\*\\*|//|<<|>>|[=!<>:]=|\\.\\.\\.|[^\\p{{L}}\\p{{N}}_ ]),)(?=[)\\]}}])|,(?=[)\\]}}]))"
)
#: What a replacement takes a blank and a quote from, as it puts in nothing of its own where a string is left as it is.
_BLANK_AND_QUOTE = " '"
_APART = (
    f"(?s)(?=[ '\",:|+\\-*/%@&^<>=!])(?:('[^']*+'|\"[^\"']*+'[^\"]*+\")|\"([^\"']*+)\"(?=.*('))|(,(?=[^)\\]}}])|:(?=.))(?!{_BLANK_AND_QUOTE}\\z)(?=.*( ))"
    f"|(?<=[{_IN_WORD})\\]}}.'\"])(->|\\*\\*|//|<<|>>|[=!<>]=|[|+\\-*/%@&^<>])(?=.*( ))|{_BLANK_AND_QUOTE}\\z)"
)


def stub_lines(files: DataFrame, file: str = "file", text: str = "text") -> DataFrame:
    """``file``, ``row``, ``text``, ``line`` (number) and ``statement`` of each line; strings over several lines and lines joined by a backslash are one.

    What brackets a line opens and closes is told by the line alone, so running sums take a number for each line. Files are dealt to
    tasks once and their rows stay there.
    """
    whole = F.concat(F.col(text), F.lit("\n"))
    held = files.select(F.col(file).alias("file"), whole.alias("text")).repartition("file")
    rows = held.select("file", F.posexplode(F.regexp_extract_all("text", F.lit(LINE), F.lit(0))).alias("row", "text"))
    bare = F.regexp_replace("text", f"(?s){_TRIPLE}|{_QUOTED}|{_COMMENT}", "")
    told = rows.select(
        "file", "row", "text",
        (F.length("text") - F.length(F.translate("text", "\n", ""))).alias("breaks"),
        (F.length(F.translate(bare, ")]}", "")) - F.length(F.translate(bare, "([{", ""))).alias("level"),
    )
    by_row = Window.partitionBy("file").orderBy("row")
    upto, before = by_row.rowsBetween(Window.unboundedPreceding, 0), by_row.rowsBetween(Window.unboundedPreceding, -1)
    placed = told.select("file", "row", "text", (F.sum("breaks").over(upto) - F.col("breaks") + 1).cast("int").alias("line"), F.sum("level").over(upto).alias("depth"))
    # A line end outside of brackets closes the statement.
    return placed.select("file", "row", "text", "line", F.coalesce(F.sum((F.col("depth") <= 0).cast("int")).over(before), F.lit(0)).alias("statement"))


def spaced_tokens(tokens: Column) -> Column:
    """Text of the tokens of an expression or signature with one manner of spacing.

    A blank follows commas and colons and surrounds operators between two operands; ``=`` and signs before an operand stand
    close; a comma before a closing bracket goes, but for that of a tuple of one; a plain string in double quotes gets single
    ones. Numbers stay as they are written.
    """
    leading = list(_LEADING_WORDS)

    def seen(t: Column) -> Column:
        """A token with what its neighbours ask about it."""
        swapped = F.startswith(t, F.lit('"')) & ~F.startswith(t, F.lit('"""')) & ~F.contains(t, F.lit("'")) & ~F.contains(t, F.lit("\\"))
        text = F.when(swapped, F.concat(F.lit("'"), F.substring(t, F.lit(2), F.length(t) - 2), F.lit("'"))).otherwise(t)
        word, led = F.regexp_like(t, F.lit("^[\\p{L}\\p{N}_]")), t.isin(*leading)
        ends = F.right(t, F.lit(1)).isin("'", '"', ")", "]", "}") | F.startswith(t, F.lit("."))
        return F.struct(text.alias("t"), word.alias("word"), led.alias("led"), ((word | ends) & ~led).alias("operand"))

    def told(parts: Column) -> Column:
        def piece(x: Column, i: Column) -> Column:
            t, last, next_ = x["t"], F.get(parts, i - 1), F.get(parts, i + 1)
            binary = t.isin(*_SPACED) & F.coalesce(last["operand"], F.lit(False))
            apart = last["word"] & (x["word"] | F.left(t, F.lit(1)).isin("'", '"'))
            return (
                F.when((t == ",") & F.coalesce(next_["t"].isin(")", "]", "}"), F.lit(False)), F.when(F.coalesce(F.get(parts, i - 2)["t"] == "(", F.lit(False)), ",").otherwise(""))
                .when((t == ",") & next_.isNotNull(), ", ")
                .when((t == ":") & next_.isNotNull(), ": ")
                .when(binary, F.concat(F.lit(" "), t, F.lit(" ")))
                .when(F.coalesce(apart, F.lit(False)), F.concat(F.lit(" "), t))
                .when(x["led"] & F.coalesce(~next_["word"], F.lit(False)), F.concat(t, F.lit(" ")))
                .otherwise(t)
            )

        return F.array_join(F.transform(parts, piece), "")

    return let(F.transform(tokens, seen), told)


def stub_statements(files: DataFrame, file: str = "file", text: str = "text") -> DataFrame:
    """``file``, ``statement``, ``line``, ``indent``, ``word`` (its first, if it begins with one, or ``@``), ``text`` of each statement that is not blank.

    A statement is gathered from its own lines. A line joined by a backslash goes on.
    """
    lines = stub_lines(files, file, text).where(~F.regexp_like("text", F.lit(f"(?s)^{_SKIPPED}\\z")))
    item = F.struct("row", "line", "text")
    grouped = lines.groupBy("file", "statement").agg(F.sort_array(F.collect_list(item)).alias("rows"))
    first = F.get("rows", F.lit(0))
    skipped = F.regexp_extract(first["text"], f"(?s)^{_SKIPPED}", 0)
    lead = F.regexp_extract(first["text"], "^[ \\t\\f][ \\t\\f\\r]*+", 0)
    return grouped.select(
        "file", "statement",
        (first["line"] + F.length(skipped) - F.length(F.translate(skipped, "\n", ""))).cast("int").alias("line"),
        F.length(F.replace(lead, F.lit("\t"), F.lit(" " * TAB))).alias("indent"),
        F.regexp_extract(first["text"], f"(?s)^{_SKIPPED}(@|{_WORD})", 1).alias("word"),
        F.array_join(F.transform("rows", lambda r: r["text"]), "").alias("text"),
    )


def _tokens(text: Column) -> Column:
    """Tokens of a statement but for comments and blanks."""
    return F.filter(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda t: ~F.regexp_like(t, F.lit("^(#|\\s|\\\\\\r?\\n)")))


def _head(tokens: Column) -> Column:
    """Tokens up to the colon outside of brackets."""
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("n"), F.lit(0).alias("end"))

    def step(acc: Column, t: Column) -> Column:
        level = F.when(t.isin("(", "[", "{"), 1).when(t.isin(")", "]", "}"), -1).otherwise(0)
        ends = (acc["end"] == 0) & (t == ":") & (acc["depth"] == 0)
        return F.struct((acc["depth"] + level).alias("depth"), (acc["n"] + 1).alias("n"), F.when(ends, acc["n"] + 1).otherwise(acc["end"]).alias("end"))

    return let(tokens, lambda ts: let(F.aggregate(ts, start, step, lambda acc: acc["end"]), lambda end: F.when(end > 0, F.slice(ts, F.lit(1), end - 1)).otherwise(ts)))


def spaced_text(text: Column) -> Column:
    """``spaced_tokens`` of the tokens of a text, which is a column or a variable; a plain signature is not cut into tokens.

    Of a plain one, blanks and comments go first, then commas before closing brackets; what is left is told by the signs beside it.
    """
    closed = F.regexp_replace(F.regexp_replace(text, _LOOSE, "$1$2"), _LAST_COMMA, "$1$2")
    simple = F.regexp_replace(F.concat(closed, F.lit(_BLANK_AND_QUOTE)), _APART, "$1$3$2$3$4$5$7$6$7")
    return F.when(F.regexp_like(text, F.lit(_SIMPLE)), simple).otherwise(spaced_tokens(_tokens(text)))


def module_of(relative_path: Column | str) -> Column:
    """Dotted module of ``a/b.pyi`` or ``a/b/__init__.pyi``."""
    bare = F.regexp_replace(relative_path, "(/__init__)?\\.pyi$", "")
    return F.replace(bare, F.lit("/"), F.lit("."))


def _functions_by_lines(files: DataFrame) -> DataFrame:
    """``stub_functions`` by way of lines and tokens, for any text."""
    word = F.col("word")
    statements = stub_statements(files)
    named = F.when(word.isin("class", "def", "async", "@"), _tokens(F.col("text"))).alias("tokens")
    statements = statements.select("file", "statement", "line", "indent", "word", "text", F.explode_outer(F.array(named)).alias("tokens"))
    second = F.get("tokens", F.lit(1))
    kind = F.when(word == "class", "class").when((word == "def") | ((word == "async") & (second == "def")), "def").when(word == "@", "@").otherwise("other")
    name = F.when(word == "async", F.get("tokens", F.lit(2))).otherwise(second)
    shown = F.when(kind == "def", F.concat(spaced_tokens(_head(F.col("tokens"))), F.lit(": ..."))).when(kind == "@", spaced_tokens(F.col("tokens")))
    told = cut_lineage(statements.select("file", "statement", "line", "indent", kind.alias("kind"), name.alias("name"), shown.alias("text")))
    # A decorator line opens nothing; the widths of indentation in all files are few.
    widths = sorted(r[0] for r in told.where(F.col("indent") > 0).select("indent").distinct().collect())
    before = Window.partitionBy("file").orderBy("statement").rowsBetween(Window.unboundedPreceding, -1)
    opener = F.struct("statement", "indent", "kind", "name")
    at_most = [0, *widths[:-1]] if widths else []
    levels = [F.last(F.when((F.col("indent") <= w) & (F.col("kind") != "@"), opener), ignorenulls=True).over(before).alias(f"_at{w}") for w in at_most]
    run = F.coalesce(F.sum((F.col("kind") != "@").cast("int")).over(before), F.lit(0)).alias("run")
    placed = told.select("file", "statement", "line", "indent", "text", "kind", "name", run, *levels)
    none = F.array().cast("array<struct<statement:bigint,indent:int,kind:string,name:string>>")
    limited = [F.when(F.lit(w) < F.col("indent"), F.col(f"_at{w}")) for w in at_most]
    openers = F.sort_array(F.array_distinct(F.filter(F.array(*limited), lambda o: o.isNotNull()))) if limited else none
    enclosed = placed.select("file", "statement", "line", "text", "kind", "name", "run", openers.alias("openers"))
    # Decorators share the run of the statement that follows them: it is the one other of the run.
    at, one = F.col("kind") == "@", F.struct("line", "kind", "name", "text", "openers")
    runs = enclosed.groupBy("file", "run").agg(
        F.sort_array(F.collect_list(F.when(at, F.struct("statement", "text")))).alias("decorators"), F.max_by(F.when(~at, one), F.when(~at, F.col("statement"))).alias("one")
    )
    functions = runs.where(F.col("one.kind") == "def").select("file", "decorators", "one.*").where(F.forall("openers", lambda o: o["kind"] == "class"))
    lines = F.concat(F.transform("decorators", lambda d: d["text"]), F.array("text"))
    return functions.select(
        "file",
        F.array_join(F.transform("openers", lambda o: o["name"]), ".").alias("class_path"),
        F.col("name").alias("function_name"),
        F.array_join(lines, "\n").alias("text"),
        "line",
    )


def stub_functions(files: DataFrame, file: str = "file", text: str = "text") -> DataFrame:
    """``file``, ``class_path``, ``function_name``, ``text``, ``line`` of each function in a module or class body, overloads each.

    ``text`` is decorators, one to a line, then the signature with ``: ...``; ``class_path`` is dotted, empty in a module body. Functions
    inside of anything else (conditions, other functions) are left out, as are empty files. ``line`` is that of ``def``.
    """
    whole = F.concat(F.col(text), F.lit("\n"))
    cut = files.select(F.col(file).alias("file"), whole.alias("text")).select("file", "text", F.regexp_extract_all("text", F.lit(UNIT), F.lit(0)).alias("units"))
    # What the expression leaves out does not match; a vertical tab is blank in tokens alone.
    regular = (F.octet_length(F.array_join("units", "")) == F.octet_length("text")) & ~F.contains("text", F.lit("\v"))
    dealt = cut.select("file", F.when(regular, F.col("units")).otherwise(F.array("text")).alias("units"), F.coalesce(regular, F.lit(False)).alias("regular"))
    # An outer explode, as the expression would be evaluated once more to leave out empty arrays.
    units = dealt.select("file", "regular", F.posexplode_outer("units").alias("row", "unit"))
    parted = units.select("*", F.when(F.col("regular"), F.regexp_extract("unit", f"(?s)^{_BEFORE}*+", 0)).alias("lead"))
    bodies = parted.select("file", "row", "regular", "unit", "lead", F.substring("unit", F.length("lead") + 1, F.length("unit")).alias("body"))
    keyed = bodies.select("*", F.regexp_extract("body", _KEY, 1).alias("key"), F.regexp_extract("body", f"^{_GAP}", 0).alias("gap"))
    kind = (
        F.when(~F.col("regular"), "text").when(F.col("body") == "", "end").when(F.col("key") == "class", "class").when(F.endswith("key", F.lit("def")), "def").otherwise("other")
    )
    kinds = keyed.select("*", kind.alias("kind"))
    head = F.when(F.col("kind") == "def", F.regexp_extract("body", _SIGNATURE, 1))
    name = F.when(F.col("kind").isin("class", "def"), F.nullif(F.regexp_extract("body", _NAME, 2), F.lit("")))
    decorators = F.when((F.col("kind") == "def") & F.contains("lead", F.lit("@")), F.regexp_extract_all("lead", F.lit(f"(?s)\\G(?:{_BLANK_LINE})*+({_DECORATOR})"), F.lit(1)))
    # Only where a line is joined, or begins with a carriage return, the gap is not the indentation.
    blanks = F.when(F.regexp_like("gap", F.lit("^\\r|\\\\")), F.regexp_extract("body", "^[ \\t\\f][ \\t\\f\\r]*+", 0)).otherwise(F.col("gap"))
    indent = F.length(F.replace(blanks, F.lit("\t"), F.lit(" " * TAB)))

    def breaks(c: str) -> Column:
        return F.length(c) - F.length(F.translate(c, "\n", ""))

    read = kinds.select(
        "file", "row", "kind", name.alias("name"), F.when(F.col("regular"), indent).alias("indent"), (breaks("lead") + breaks("gap")).alias("offset"), breaks("unit").alias("breaks"),
        F.when(~F.col("regular"), F.col("unit")).alias("unit"), head.alias("head"), decorators.alias("decorators"),
    )
    above = F.coalesce(F.array_join(F.transform("decorators", lambda d: F.concat(spaced_text(d), F.lit("\n"))), ""), F.lit(""))
    shown = F.when(F.col("kind") == "def", F.concat(above, spaced_text(F.col("head")), F.lit(": ...")))
    told = sized(read.select("file", "row", "kind", "name", "indent", "offset", "breaks", F.when(F.col("kind") == "text", F.col("unit")).otherwise(shown).alias("text")), "statements")
    seen = told.select("indent", (F.col("kind") == "text").alias("whole")).distinct().collect()
    found = _functions_of_statements(told.where(F.col("kind") != "text"), sorted({r["indent"] for r in seen if r["indent"]}))
    if any(r["whole"] for r in seen):
        # The line end at the end is put there again.
        rest = told.where(F.col("kind") == "text").select("file", F.expr("substring(text, 1, length(text) - 1)").alias("text"))
        found = found.unionByName(_functions_by_lines(rest))
    return found


def _functions_of_statements(told: DataFrame, widths: list[int]) -> DataFrame:
    """Functions among the statements of each file; ``widths`` are those of indentation in all files, which are few."""
    before = Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    opener = F.struct("row", "kind", "name")
    at_most = [0, *widths[:-1]] if widths else []
    levels = [F.last(F.when((F.col("indent") <= w) & (F.col("kind") != "end"), opener), ignorenulls=True).over(before).alias(f"_at{w}") for w in at_most]
    line = (F.coalesce(F.sum("breaks").over(before), F.lit(0)) + F.col("offset") + 1).cast("int").alias("line")
    functions = told.select("file", "indent", "kind", "name", "text", line, *levels).where(F.col("kind") == "def")
    names, in_classes = [F.lit(None).cast("string")], F.lit(True)
    for last, w in zip([None, *at_most], at_most, strict=False):
        at, encloses = F.col(f"_at{w}"), (F.lit(w) < F.col("indent")) & F.col(f"_at{w}").isNotNull()
        # The statement remembered for the width before is the same one where none came between.
        again = F.lit(False) if last is None else F.coalesce(F.col(f"_at{last}")["row"] == at["row"], F.lit(False))
        names.append(F.when(encloses & ~again, at["name"]))
        in_classes = in_classes & F.when(encloses, at["kind"] == "class").otherwise(F.lit(True))
    return functions.where(in_classes).select("file", F.concat_ws(".", *names).alias("class_path"), F.col("name").alias("function_name"), "text", "line")
