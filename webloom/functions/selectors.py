"""CSS and XPath selectors as data.

A selector is read into alternatives of steps (``read_css`` / ``read_xpath``), small structs that sit
in a column next to the page. Matching is one array expression over the elements of the page, so
thousands of different rules run in one plan and no rule becomes a join or a branch of its own.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from webloom.functions.urls import apply_sql, let

_TESTS = (
    "comb:string,tag:string,id:string,classes:array<string>,"
    "attrs:array<struct<name:string,op:string,value:string>>,nth:array<struct<of:string,a:int,b:int>>,"
    "texts:array<struct<own:boolean,op:string,value:string>>"
)
# What an element must not match (``barred``), and lists of which it must hold a match each (``has``).
BARRED = f"array<struct<{_TESTS}>>"
HAS = f"array<array<struct<{_TESTS}>>>"
STEP = f"struct<{_TESTS},barred:{BARRED},has:{HAS}>"
ALTERNATIVES = f"array<array<{STEP}>>"
FIELD_PLAN = (
    f"struct<name:string,kind:string,attr:string,alts:{ALTERNATIVES},take:string,"
    "pattern:string,group:int,error:string>"
)
RULE_PLAN = f"struct<whole:boolean,items:{ALTERNATIVES},links:{ALTERNATIVES},fields:array<{FIELD_PLAN}>,error:string>"

_CSS_PART = re.compile(
    r"""\s*(?P<comb>[>+~])\s*
    |(?P<blank>\s+)
    |(?P<tag>\*|[A-Za-z_][\w-]*)
    |\#(?P<id>[\w-]+)
    |\.(?P<cls>[\w-]+)
    |\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[~|^$*!]?=)\s*(?:"(?P<dq>[^"]*)"|'(?P<sq>[^']*)'|(?P<bare>[^\]\s]+))\s*)?\]
    |:(?P<nth>nth-(?:last-)?(?:child|of-type))\(\s*(?P<expr>[^)]*?)\s*\)
    |:(?P<inner>not|has)\((?P<list>(?:[^()"']|"[^"]*"|'[^']*'|\([^()]*\))*)\)
    |:(?P<text>contains|containsOwn)\(\s*(?:"(?P<tdq>[^"]*)"|'(?P<tsq>[^']*)'|(?P<tbare>[^()"']*?))\s*\)
    |:(?P<pseudo>empty|first-child|last-child|only-child|first-of-type|last-of-type|only-of-type)""",
    re.X,
)
# Short pseudo classes as (which position, a, b) of a*n+b.
_PSEUDO = {
    "empty": [("size", 0, 0)],
    "first-child": [("child", 0, 1)],
    "last-child": [("last-child", 0, 1)],
    "only-child": [("child", 0, 1), ("last-child", 0, 1)],
    "first-of-type": [("of-type", 0, 1)],
    "last-of-type": [("last-of-type", 0, 1)],
    "only-of-type": [("of-type", 0, 1), ("last-of-type", 0, 1)],
}


def _step(comb: str) -> dict:
    return {"comb": comb, "tag": "", "id": "", "classes": [], "attrs": [], "nth": [], "texts": [], "barred": [], "has": []}


def _attr_test(m: re.Match) -> dict:
    return {"name": m["attr"].lower(), "op": m["op"] or "", "value": m["dq"] or m["sq"] or m["bare"] or ""}


def _compounds(listed: str, selector: str, lead: bool = False) -> list[dict]:
    """The members of a list inside :not() or :has(): compounds of simple selectors, after ``>`` if ``lead``."""
    out = []
    for part in _split_list(listed):
        part, comb = part.strip(), " "
        if lead and part.startswith(">"):
            part, comb = part[1:], ">"
        steps = read_css(part)[0]
        if len(steps) > 1 or steps[0]["barred"] or steps[0]["has"]:
            raise ValueError(f"unsupported inside :not() or :has(): {selector}")
        out.append(steps[0] | {"comb": comb})
    return out


def _a_n_plus_b(expr: str) -> tuple[int, int]:
    e = expr.replace(" ", "").lower()
    if e in ("odd", "even"):
        return 2, int(e == "odd")
    m = re.fullmatch(r"([+-]?\d*)n([+-]\d+)?", e)
    if m:
        a = {"": 1, "+": 1, "-": -1}.get(m[1])
        return int(m[1]) if a is None else a, int(m[2] or 0)
    return 0, int(e)


def read_css(selector: str) -> list[list[dict]]:
    """Alternatives of steps; ValueError for what the subset does not cover."""
    out = []
    for part in _split_list(selector):
        text, at = part.strip(), 0
        steps, step, empty = [], _step(""), True
        while at < len(text):
            m = _CSS_PART.match(text, at)
            if m is None:
                raise ValueError(f"unsupported selector: {selector}")
            at = m.end()
            if m["comb"] or m["blank"]:
                if empty:
                    raise ValueError(f"dangling combinator: {selector}")
                steps.append(step)
                step, empty = _step(m["comb"] or " "), True
                continue
            if m["tag"]:
                if not empty:
                    raise ValueError(f"misplaced tag: {selector}")
                step["tag"] = "" if m["tag"] == "*" else m["tag"].lower()
            elif m["id"]:
                step["id"] = m["id"]
            elif m["cls"]:
                step["classes"].append(m["cls"])
            elif m["attr"]:
                step["attrs"].append(_attr_test(m))
            elif m["inner"] == "not":
                step["barred"] += _compounds(m["list"], selector)
            elif m["inner"] == "has":
                step["has"].append(_compounds(m["list"], selector, lead=True))
            elif m["text"]:
                value = next(v for v in (m["tdq"], m["tsq"], m["tbare"]) if v is not None)
                step["texts"].append({"own": m["text"] == "containsOwn", "op": "*=", "value": value})
            elif m["nth"]:
                a, b = _a_n_plus_b(m["expr"])
                step["nth"].append({"of": m["nth"].removeprefix("nth-"), "a": a, "b": b})
            else:
                step["nth"] += [{"of": of, "a": a, "b": b} for of, a, b in _PSEUDO[m["pseudo"]]]
            empty = False
        if empty:
            raise ValueError(f"empty selector: {selector!r}")
        out.append([*steps, step])
    return out


def _split_list(selector: str) -> list[str]:
    return re.split(r""",(?=(?:[^"'()]|"[^"]*"|'[^']*'|\([^()]*\))*$)""", selector)


_XP_STEP = re.compile(
    r"(?P<sep>//|/)?(?:(?P<text>text\(\))|(?P<up>\.\.)|@(?P<attr>[\w:-]+)"
    r"|(?:(?P<axis>child|descendant|self|parent|ancestor|following-sibling|preceding-sibling)::)?(?P<tag>\*|[A-Za-z_][\w-]*|\.))"
)
# How an element lies to one that the path has reached, by axis.
_AXES = {
    "child": ">", "descendant": " ", "self": "self", "parent": "parent", "ancestor": "ancestor",
    "following-sibling": "after", "preceding-sibling": "before",
}
_XP_CLASS = re.compile(
    r"contains\(\s*concat\(\s*['\"] ['\"]\s*,\s*normalize-space\(@class\)\s*,\s*['\"] ['\"]\s*\)\s*,\s*"
    r"['\"] (?P<cls>[\w-]+) ['\"]\s*\)"
)
_XP_TEST = re.compile(
    r"@(?P<attr>[\w:-]+)(?:\s*=\s*(?:'(?P<sq>[^']*)'|\"(?P<dq>[^\"]*)\"))?\Z"
    r"|(?P<fn>contains|starts-with)\(\s*@(?P<fattr>[\w:-]+)\s*,\s*(?:'(?P<fsq>[^']*)'|\"(?P<fdq>[^\"]*)\")\s*\)\Z"
    r"|(?P<tfn>contains|starts-with)\(\s*(?P<tof>\.|text\(\))\s*,\s*(?:'(?P<tsq>[^']*)'|\"(?P<tdq>[^\"]*)\")\s*\)\Z"
    r"|(?P<eof>\.|text\(\))\s*=\s*(?:'(?P<esq>[^']*)'|\"(?P<edq>[^\"]*)\")\Z"
    r"|not\(\s*(?P<none>.*?)\s*\)\Z"
)
_XP_PLACE = re.compile(
    r"(?P<at>\d+)|(?:position\(\)\s*=\s*)?last\(\)(?:\s*-\s*(?P<back>\d+))?(?P<last>)"
    r"|position\(\)\s*(?:(?P<op>=|!=|<=|>=|<|>)\s*(?P<k>\d+)|(?P<inner><)\s*last\(\)|mod\s+(?P<mod>[1-9]\d*)\s*=\s*(?P<rest>\d+))"
)
_XP_COUNT = re.compile(
    r"count\(\s*(?P<deep>\.//|descendant::)?(?:\./|child::)?(?P<tag>\*|[A-Za-z_][\w-]*)\s*\)\s*(?P<op>=|!=|<=|>=|<|>)\s*(?P<k>\d+)"
)
_XP_HOLDS = re.compile(r"(?P<deep>\.//|descendant::)?(?:\./|child::)?(?P<tag>\*|[A-Za-z_][\w-]*)(?P<tests>\[.*\])?")
_XP_PICK = re.compile(r"\[\s*(?:(?P<k>[1-9]\d*)|last\(\))\s*\]")


def read_xpath(expr: str) -> tuple[list[list[dict]], str]:
    """Paths (of a union, each as steps) and what to take: '' (element), 'text()' or '@name'."""
    paths = [_read_path(part, expr) for part in _parts(expr, "|")]
    if len({take for _, take in paths}) > 1:
        raise ValueError(f"a union of elements and values: {expr}")
    return [steps for alts, _ in paths for steps in alts], paths[0][1]


def _parts(text: str, mark: str) -> list[str]:
    """Text between the marks (``|``, or a word between blanks) that stand in no quotes, parentheses or brackets."""
    found, start, depth, quote, word = [], 0, 0, "", mark.isalpha()
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif not depth and text.startswith(mark, i) and i >= start:
            if not word or re.fullmatch(r"[\s)\]'\"]\w+[\s(]", text[max(i - 1, 0) : i + len(mark) + 1]):
                found.append(text[start:i])
                start = i + len(mark)
    return [*found, text[start:]]


def _read_path(path: str, expr: str) -> tuple[list[list[dict]], str]:
    """Alternatives of steps of one path, which has several by ``or`` and by a union in parentheses."""
    text = path.strip()
    if not text.startswith("("):
        return _read_steps(text.removeprefix(".") if text.startswith("./") else text, expr, lead=True)
    end = _closing(text, 0)
    alts, take = read_xpath(text[1:end])
    rest = text[end + 1 :].strip()
    pick = _XP_PICK.match(rest)
    if pick:  # the n-th of all elements that the path reaches
        if len(alts) > 1 or take == "text()" or any(t["of"] == "pick" for t in alts[0][-1]["nth"]):
            raise ValueError(f"unsupported xpath: {expr}")
        alts[0][-1]["nth"].append({"of": "pick", "a": 0, "b": int(pick["k"] or -1)})
        if take:
            alts[0][-1]["attrs"].append({"name": take[1:], "op": "", "value": ""})
        rest = rest[pick.end() :].strip()
    if not rest:
        return alts, take
    if take:
        raise ValueError(f"unsupported xpath: {expr}")
    more, take = _read_steps(rest, expr, lead=False)
    return [a + m for a in alts for m in more], take


def _read_steps(text: str, expr: str, lead: bool) -> tuple[list[list[dict]], str]:
    at, alts, take, whole = 0, [[]], "", lead
    while at < len(text):
        m = _XP_STEP.match(text, at)
        if m is None or take or (not lead and not m["sep"]):
            raise ValueError(f"unsupported xpath: {expr}")
        at, lead = m.end(), False
        deep = m["sep"] == "//"
        if m["tag"] == "." and not m["axis"]:
            continue
        if m["text"] or m["attr"]:
            take = "text()" if m["text"] else "@" + m["attr"].lower()
            if deep or (whole and not alts[0]):
                alts = [[*steps, _step(" ")] for steps in alts]
            continue
        axis = "parent" if m["up"] else m["axis"] or "child"
        if deep and axis not in ("child", "descendant"):
            raise ValueError(f"unsupported xpath: {expr}")
        step = _step(" " if deep else _AXES[axis])
        step["tag"] = "" if m["up"] or m["tag"] == "*" else m["tag"].lower()
        variants = [step]
        while at < len(text) and text[at] == "[" and not m["up"]:
            end = _closing(text, at)
            either = [_parts(one, "and") for one in _parts(text[at + 1 : end], "or")]
            grown = []
            for v in variants:
                # A position counts the elements that the predicates before it leave.
                filtered = any(v[k] for k in ("classes", "attrs", "nth", "texts", "barred", "has"))
                if any("match" in t["of"] for t in v["nth"]):
                    raise ValueError(f"unsupported predicate: {expr}")
                for tests in either:
                    w = {k: list(x) if isinstance(x, list) else x for k, x in v.items()}
                    for test in tests:
                        _add_test(w, test.strip(), expr, axis, filtered)
                    grown.append(w)
            variants, at = grown, end + 1
        alts = [[*steps, v] for steps in alts for v in variants]
    if not alts[0] and not take:
        raise ValueError(f"unsupported xpath: {expr}")
    return alts, take


def _closing(text: str, at: int) -> int:
    """Where the parenthesis or bracket at a place is closed."""
    quote, depth = "", 0
    for i in range(at, len(text)):
        if quote:
            quote = "" if text[i] == quote else quote
        elif text[i] in "'\"":
            quote = text[i]
        elif text[i] in "([":
            depth += 1
        elif text[i] in ")]":
            depth -= 1
            if not depth:
                return i
    raise ValueError(f"unclosed predicate: {text}")


def _compared(op: str, k: int) -> tuple[int, int]:
    """A comparison with a number as a*n+b."""
    return {"=": (0, k), ">=": (1, k), ">": (1, k + 1), "<=": (-1, k), "<": (-1, k - 1)}[op]


def _add_place(step: dict, m: re.Match, expr: str, axis: str, filtered: bool) -> None:
    """A position: among siblings of the tag, or among what earlier predicates leave, or along an axis."""
    last = m["last"] is not None or m["inner"] is not None
    if axis in ("following-sibling", "preceding-sibling", "ancestor"):
        of = "axis"
    elif axis == "child":
        of = "match" if filtered else "of-type" if step["tag"] else "child"
    else:
        of = ""
    if not of or (of == "axis" and (filtered or last)):
        raise ValueError(f"unsupported predicate: {expr}")
    of = "last-" + of if last else of
    if m["inner"]:
        a, b = 1, 2
    elif last:
        a, b = 0, int(m["back"] or 0) + 1
    elif m["mod"]:
        a, b = int(m["mod"]), int(m["rest"])
        if b >= a:
            a, b = 0, 0  # no remainder is that large
    elif m["op"] == "!=":
        raise ValueError(f"unsupported predicate: {expr}")
    else:
        a, b = _compared(m["op"] or "=", int(m["at"] or m["k"]))
    step["nth"].append({"of": of, "a": a, "b": b})


def _add_test(step: dict, test: str, expr: str, axis: str = "child", filtered: bool = False) -> None:
    by_class = _XP_CLASS.fullmatch(test)
    if by_class:
        step["classes"].append(by_class["cls"])
        return
    if place := _XP_PLACE.fullmatch(test):
        _add_place(step, place, expr, axis, filtered)
        return
    if count := _XP_COUNT.fullmatch(test):
        of = ("within:" if count["deep"] else "count:") + count["tag"].lower().replace("*", "")
        if count["op"] == "!=":
            step["barred"].append(_step(" ") | {"nth": [{"of": of, "a": 0, "b": int(count["k"])}]})
        else:
            a, b = _compared(count["op"], int(count["k"]))
            step["nth"].append({"of": of, "a": a, "b": b})
        return
    m = _XP_TEST.match(test)
    if m is None:
        _add_holds(step, test, expr)
    elif m["attr"]:
        has_value = m["sq"] is not None or m["dq"] is not None
        step["attrs"].append(
            {"name": m["attr"].lower(), "op": "=" if has_value else "", "value": m["sq"] or m["dq"] or ""}
        )
    elif m["none"] is not None:
        barred = _step(" ") | {"tag": step["tag"]}
        _add_test(barred, m["none"].strip(), expr, axis, filtered)
        if barred["barred"] or barred["has"] or any(t["of"] in ("axis", "match", "last-match") for t in barred["nth"]):
            raise ValueError(f"unsupported predicate: {expr}")
        step["barred"].append(barred)
    elif m["tfn"] or m["eof"]:
        op = {"contains": "*=", "starts-with": "^=", None: "="}[m["tfn"]]
        value = next((m[g] for g in ("tsq", "tdq", "esq", "edq") if m[g]), "")
        step["texts"].append({"own": (m["tof"] or m["eof"]) != ".", "op": op, "value": value})
    else:
        op = "*=" if m["fn"] == "contains" else "^="
        step["attrs"].append({"name": m["fattr"].lower(), "op": op, "value": m["fsq"] or m["fdq"] or ""})


def _add_holds(step: dict, test: str, expr: str) -> None:
    """A predicate that is a path of one step: the element has such a child or descendant."""
    m = _XP_HOLDS.fullmatch(test)
    if m is None:
        raise ValueError(f"unsupported predicate: {expr}")
    held, tests, at = _step(" " if m["deep"] else ">"), m["tests"] or "", 0
    held["tag"] = "" if m["tag"] == "*" else m["tag"].lower()
    while at < len(tests):
        end = _closing(tests, at)
        if tests[at] != "[" or len(_parts(tests[at + 1 : end], "or")) > 1:
            raise ValueError(f"unsupported predicate: {expr}")
        for one in _parts(tests[at + 1 : end], "and"):
            _add_test(held, one.strip(), expr, filtered=at > 0)
        at = end + 1
    if held["barred"] or held["has"] or any("match" in t["of"] for t in held["nth"]):
        raise ValueError(f"unsupported predicate: {expr}")
    step["has"].append([held])


def read_regex(expr: str) -> tuple[str, int]:
    """Pattern in the dialect Spark runs and the group to return; look-around is rejected."""
    if re.search(r"\(\?(?:[=!]|<[=!])|\\[1-9]", expr):
        raise ValueError("look-around and back references are not supported")
    groups = re.compile(expr).groups
    return "(?d)" + expr.replace("(?P<", "(?<"), min(groups, 1)


def plan_rule(item_selector: str, link_selector: str, fields: list[dict]) -> dict:
    """One rule row as plain data; what cannot be read matches nothing and is kept as an error, per field or rule."""
    errors: list[str] = []

    def css(selector: str) -> list[list[dict]]:
        try:
            return read_css(selector)
        except ValueError as e:
            errors.append(str(e))
            return []

    plans: dict[str, dict] = {}
    for f in fields or []:
        name, kind = (f.get("name") or "").strip(), (f.get("kind") or "").strip().lower()
        expr, attr = (f.get("expr") or "").strip(), (f.get("attr") or "").strip() or "text"
        if not name or not expr or kind not in ("xpath", "css", "regex"):
            continue
        plan = {
            "name": name, "kind": kind, "attr": attr if kind == "regex" else attr.lower(),
            "alts": [], "take": "", "pattern": "", "group": 0, "error": "",
        }
        try:
            if kind == "css":
                plan["alts"] = read_css(expr)
            elif kind == "xpath":
                plan["alts"], plan["take"] = read_xpath(expr)
            else:
                plan["pattern"], plan["group"] = read_regex(expr)
        except (ValueError, re.error) as e:
            plan["error"] = str(e)
        plans.pop(name, None)
        plans[name] = plan
    item, link = (item_selector or "").strip(), (link_selector or "").strip()
    return {
        "whole": not item,
        "items": css(item) if item else [],
        "links": css(link) if link else [],
        "fields": list(plans.values()),
        "error": "; ".join(errors),
    }


def rule_plan(item_selector: Column, link_selector: Column, fields: Column) -> Column:
    """STRUCT plan of every row of a rules table (``fields`` is the array of field structs)."""
    packed = F.to_json(F.struct(item_selector.alias("i"), link_selector.alias("l"), fields.alias("f")))
    return F.from_json(_plan_json(packed), RULE_PLAN)


def rule_plan_lit(item_selector: str, link_selector: str, fields: list[dict]) -> Column:
    """The plan of one rule given in code."""
    return F.from_json(F.lit(json.dumps(plan_rule(item_selector, link_selector, fields))), RULE_PLAN)


def css_plan_lit(selector: str) -> Column:
    return F.from_json(F.lit(json.dumps(read_css(selector))), ALTERNATIVES)


def path_plan_lit(expr: str) -> Column:
    return F.from_json(F.lit(json.dumps(read_xpath(expr)[0])), ALTERNATIVES)


@F.arrow_udf(StringType())
def _plan_json(packed):
    import pyarrow as pa

    out = []
    for text in packed.to_pylist():
        r = json.loads(text)
        out.append(json.dumps(plan_rule(r.get("i", ""), r.get("l", ""), r.get("f") or [])))
    return pa.array(out, pa.string())


_ATTR_OK = """coalesce(CASE t.op
    WHEN '' THEN n.attrs[t.name] IS NOT NULL
    WHEN '=' THEN n.attrs[t.name] = t.value
    WHEN '!=' THEN coalesce(n.attrs[t.name] != t.value, true)
    WHEN '~=' THEN array_contains(split(n.attrs[t.name], r'\\s+'), t.value)
    WHEN '^=' THEN t.value != '' AND startswith(n.attrs[t.name], t.value)
    WHEN '$=' THEN t.value != '' AND endswith(n.attrs[t.name], t.value)
    WHEN '*=' THEN t.value != '' AND contains(n.attrs[t.name], t.value)
    WHEN '|=' THEN n.attrs[t.name] = t.value OR startswith(n.attrs[t.name], concat(t.value, '-')) END, false)"""
# The elements below one follow it in document order, so those it has to hold are looked for in a slice.
_INSIDE = "slice(q.nodes, n.pos - q.below + 1, n.end_pos - n.pos)"
_COUNTED = f"""size(filter({_INSIDE}, k -> (startswith(t.of, 'within:') OR k.parent_pos = n.pos)
    AND substring_index(t.of, ':', -1) IN ('', k.tag)))"""
_NTH_AT = f"""CASE t.of WHEN 'size' THEN n.end_pos - n.pos + n.t1 - n.t0 WHEN 'child' THEN n.el_idx WHEN 'of-type' THEN n.type_idx
    WHEN 'last-child' THEN n.n_el - n.el_idx + 1 WHEN 'last-of-type' THEN n.n_type - n.type_idx + 1 ELSE {_COUNTED} END"""


def _of_form(value: str) -> str:
    """Whether a number is a*n+b of a test ``t``."""
    return f"exists(array({value}), v -> CASE WHEN t.a = 0 THEN v = t.b ELSE (v - t.b) % t.a = 0 AND (v - t.b) * sign(t.a) >= 0 END)"


# Positions that depend on more than the element are tested where the step is.
_NTH_OK = f"(t.of IN ('axis', 'pick', 'match', 'last-match') OR {_of_form(_NTH_AT)})"
_TEXT = "if(t.own, n.own_text, substring(q.text, n.t0 + 1, n.t1 - n.t0))"
_TEXT_OK = f"""coalesce(CASE t.op WHEN '=' THEN {_TEXT} = t.value WHEN '^=' THEN startswith({_TEXT}, t.value)
    ELSE contains({_TEXT}, t.value) END, false)"""
_COMPOUND_OK = f"""(st.tag = '' OR n.tag = st.tag) AND (st.id = '' OR n.id_attr = st.id)
    AND forall(st.classes, c -> array_contains(n.classes, c)) AND forall(st.attrs, t -> {_ATTR_OK})
    AND forall(st.nth, t -> {_NTH_OK}) AND forall(st.texts, t -> {_TEXT_OK})"""


def _compound_ok(node: str, test: str) -> str:
    """The tests of one compound on one element, both named as given."""
    return re.sub(r"\bst\.", f"{test}.", re.sub(r"\bn\.", f"{node}.", _COMPOUND_OK))


_HOLDS = f"exists({_INSIDE}, d -> (h.comb = ' ' OR d.parent_pos = n.pos) AND {_compound_ok('d', 'h')})"
_STEP_OK = f"""{_COMPOUND_OK} AND NOT exists(st.barred, b -> {_compound_ok("n", "b")})
    AND forall(st.has, hs -> exists(hs, h -> {_HOLDS}))"""
# Among the siblings that pass the step's other tests (``ok``), counted from either end.
_MATCHING = """size(filter(q.nodes, x -> x.parent_pos = n.parent_pos AND get(ok, x.pos - q.below - 1)
    AND if(t.of = 'match', x.el_idx <= n.el_idx, x.el_idx >= n.el_idx)))"""
_MATCH_OK = f"forall(st.nth, t -> t.of NOT IN ('match', 'last-match') OR {_of_form(_MATCHING)})"


def _marked(marks: str, pos: str) -> str:
    return f"coalesce(get({marks}, {pos} - q.below), false)"


def _along(rank: str) -> str:
    """Whether the place of an element on an axis fits the step; it counts elements of the step's tag."""
    return f"forall(st.nth, t -> t.of != 'axis' OR {_of_form(rank)})"


_BETWEEN = """(size(filter(q.nodes, x -> x.parent_pos = n.parent_pos AND x.el_idx > least(m.el_idx, n.el_idx)
    AND x.el_idx < greatest(m.el_idx, n.el_idx) AND (st.tag = '' OR x.tag = st.tag))) + 1)"""
_UP = "(size(filter(d.path, a -> a > n.pos AND (st.tag = '' OR get(q.nodes, a - q.below - 1).tag = st.tag))) + 1)"
_LINKED = f"""CASE st.comb WHEN '' THEN true
    WHEN ' ' THEN exists(n.path, a -> {_marked("marks", "a")})
    WHEN '>' THEN {_marked("marks", "n.parent_pos")}
    WHEN 'self' THEN {_marked("marks", "n.pos")}
    WHEN 'parent' THEN exists({_INSIDE}, d -> d.parent_pos = n.pos AND {_marked("marks", "d.pos")})
    WHEN 'ancestor' THEN exists({_INSIDE}, d -> {_marked("marks", "d.pos")} AND {_along(_UP)})
    ELSE exists(q.nodes, m -> m.parent_pos = n.parent_pos AND {_marked("marks", "m.pos")}
        AND CASE st.comb WHEN '+' THEN n.el_idx - m.el_idx = 1 WHEN 'before' THEN n.el_idx < m.el_idx ELSE n.el_idx > m.el_idx END
        AND {_along(_BETWEEN)}) END"""


def _picked(flags: str) -> str:
    """Flags of which only the n-th one that is set stays, if the step says so; -1 stands for the last one."""
    wanted = "get(filter(st.nth, t -> t.of = 'pick'), 0).b"
    places = "filter(sequence(0, size(fm) - 1), i -> fm[i])"
    chosen = let(places, "ps", f"get(ps, if({wanted} < 0, size(ps), {wanted}) - 1)")
    only = let(chosen, "at", "transform(fm, (x, i) -> coalesce(i = at, false))")
    return let(flags, "fm", f"CASE WHEN {wanted} IS NULL THEN fm ELSE {only} END")


def select_sql(query: str) -> str:
    """Elements that match ``query`` = STRUCT<nodes, alts, below, context, text>, in document order.

    Each step turns the flags of the elements reached so far into the flags of the next ones; the
    cheap test on the element itself stands before the walk over its ancestors.
    """
    start = "transform(sequence(0, size(q.nodes)), i -> coalesce(i = q.context, false))"
    passed = f"transform(q.nodes, n -> coalesce({_STEP_OK}, false))"
    flags = let(passed, "ok", f"transform(q.nodes, (n, at) -> CASE WHEN get(ok, at) AND {_MATCH_OK} THEN {_LINKED} ELSE false END)")
    after = _picked(f"concat(array(false), {flags})")
    reached = f"transform(q.alts, steps -> aggregate(steps, {start}, (marks, st) -> {after}))"
    hit = f"exists(all_marks, mk -> {_marked('mk', 'n.pos')})"
    found = let(reached, "all_marks", f"filter(q.nodes, n -> {hit})")
    return let(query, "q", f"CASE WHEN size(q.alts) = 0 THEN slice(q.nodes, 1, 0) ELSE {found} END")


_SELECT = f"x -> {select_sql('x')}"


def select_nodes(nodes: Column, alts: Column, below: Column, context: Column, text: Column | None = None) -> Column:
    """Elements of a scope that match, in document order (T6 takes the first).

    ``nodes`` is a contiguous run of elements, ``below`` the position just before it. ``context`` is
    NULL for CSS; for XPath it is the offset (pos - below) of the node the path starts from. ``text`` is
    the page's text; without it, tests of the text below an element fail.
    """
    query = F.struct(
        nodes.alias("nodes"), alts.alias("alts"), below.alias("below"), context.cast("int").alias("context"),
        (F.lit(None) if text is None else text).cast("string").alias("text"),
    )
    return apply_sql(query, _SELECT)
