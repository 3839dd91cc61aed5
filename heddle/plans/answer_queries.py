"""Queries over answers: mathematical meaning, structure, the rules by kind of task."""

from __future__ import annotations

from pyspark.sql import functions as F

from heddle.functions import algebra
from heddle.operators import review
from heddle.plans.registry import query
from heddle.sources.shared import materialize, read_table


def _items(spark, d, kinds: int):
    """Rows of lineitem with whole numbers q and n, a kind of answer, and e: 0 if the second answer is to mean the same."""
    item = read_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_suppkey")
    return item.select(F.col("l_quantity").cast("int").alias("q"), F.col("l_linenumber").cast("int").alias("n"), (F.col("l_orderkey") % kinds).cast("int").alias("kind"), (F.col("l_suppkey") % 3 == 0).cast("int").alias("e"))


def _form(pattern: str, *args):
    return F.format_string(pattern, *(F.col(a).cast("int") if isinstance(a, str) else a.cast("int") for a in args))


def _by_kind(forms):
    out = F.lit(None).cast("string")
    for i, f in enumerate(forms):
        out = F.when(F.col("kind") == i, f).otherwise(out)
    return out


@query(
    "str22_symbolic_equality",
    r"""SELECT kind, n, said, count(*) rows FROM (SELECT kind, n, CASE kind
 WHEN 6 THEN CASE WHEN e = 1 OR n = 1 THEN 'equal' ELSE 'undecided' END
 WHEN 7 THEN CASE WHEN e = 1 THEN 'undecided' ELSE 'equal' END
 ELSE CASE WHEN e = 1 THEN 'different' ELSE 'equal' END END said
 FROM (SELECT l_orderkey % 8 kind, l_linenumber n, (l_suppkey % 3 = 0)::INT e FROM lineitem)) GROUP BY ALL""",
)
def str22(spark, d):
    """Fractions, products, equations up to a factor, roots, roots of roots, rational functions, factorials (not understood) and functions that aren't evaluated."""
    q, n, e = F.col("q"), F.col("n"), F.col("e")
    first = [
        _form("$\\dfrac{%d}{%d}$", "q", "n"), _form("(x+%d)(x-%d)", "q", "n"), _form("%dx+%dy=%d", "n", "n", "q"), _form("\\frac{%d+%d\\sqrt{%d}}{2}", "q", "n", "n"), _form("\\sqrt{%d+2\\sqrt{%d}}", q + n, q * n),
        _form("\\frac{1}{x-%d}-\\frac{1}{x+%d}", "n", "q"), _form("%d!", "n"), _form("%d\\sin(2x)", "n"),
    ]
    second = [
        _form("%d/%d", 2 * q + e, 2 * n), _form("x^2+(%d)x-%d", q - n, q * n + e), _form("%d=%dy+%dx", 2 * q + e, 2 * n, 2 * n), _form("\\frac{%d}{2}+\\frac12\\sqrt{%d}", q + e, n * n * n), _form("\\sqrt%d+\\sqrt{%d}", q, n + e),
        _form("\\frac{%d}{x^2+(%d)x-%d}", q + n + e, q - n, q * n), F.when(e == 1, _form("%d!", "n")).otherwise(_form("%d!", F.lit(1))), F.when(e == 1, _form("%d\\sin(x)\\cos(x)", 2 * n)).otherwise(_form("\\sin(x+x)*%d", "n")),
    ]
    said = algebra.math_verdict(_by_kind(first), _by_kind(second))
    return _items(spark, d, 8).select(F.col("kind").cast("long").alias("kind"), F.col("n").cast("long").alias("n"), said.alias("said")).groupBy("kind", "n", "said").agg(F.count("*").alias("rows"))


@query(
    "str21_answer_structure",
    r"""SELECT kind, n, said, count(*) rows FROM (SELECT l_orderkey % 8 kind, l_linenumber n,
 CASE WHEN l_suppkey % 3 <> 0 OR (l_orderkey % 8 = 4 AND l_quantity::INT = l_linenumber) THEN 'equal' ELSE 'different' END said FROM lineitem) GROUP BY ALL""",
)
def str21(spark, d):
    """Lists in any order with assignments that fit one partner only, intervals, unions, tuples, matrices with a factor, vectors, assignments, letters of a choice."""
    q, n, e = F.col("q"), F.col("n"), F.col("e")
    choice = F.format_string("Which? $\\textbf{(A)}\\ %s \\qquad \\textbf{(B)}\\ %s$", _form("\\frac{%d}{2}", "q"), _form("x+%d", "n"))
    first = [
        _form("x=%d, %d, y=%d", "n", "n", "q"), _form("(%d, \\frac{%d}{2}]", "n", "q"), _form("(-%d,-%d)\\cup[%d,\\infty)", "q", "n", "q"), _form("\\left(%d,\\,%d\\right)", "q", "n"), _form("\\frac1%d\\begin{pmatrix}%d&%d\\\\0&1\\end{pmatrix}", F.lit(3), "q", "n"),
        _form("\\begin{pmatrix}%d\\\\-%d\\end{pmatrix}", "q", "n"), _form("k = %d", "q"), algebra.chosen_option(choice, F.lit("B")),
    ]
    second = [
        F.when(e == 0, _form("%d \\text{ and } x=%d, %d", "n", "n", "q")).otherwise(_form("%d, z=%d, z=%d", "n", "n", "q")), F.when(e == 0, _form("(%d,%d/2]", "n", "q")).otherwise(_form("[%d,%d/2]", "n", "q")),
        F.when(e == 0, _form("[%d,\\infty) \\cup (-%d,-%d)", "q", "q", "n")).otherwise(_form("[%d,\\infty) \\cup (-%d,-%d]", "q", "q", "n")), F.when(e == 0, _form("(%d,%d)", "q", "n")).otherwise(_form("(%d,%d)", "q", n + 1)),
        F.when(e == 0, _form("\\begin{pmatrix}%d/3&%d/3\\\\0&\\phantom{-}1/3\\end{pmatrix}", "q", "n")).otherwise(_form("\\begin{pmatrix}%d/3&%d/3\\\\0&1/3\\end{pmatrix}", "n", "q")),
        F.when(e == 0, _form("(%d,-%d)", "q", "n")).otherwise(_form("(%d,%d)", "q", "n")), F.when(e == 0, _form("%d\\text{ cm}^2.", "q")).otherwise(_form("m=%d", q + 1)), F.when(e == 0, _form("%d+x", "n")).otherwise(_form("%d-x", "n")),
    ]
    said = algebra.math_verdict(_by_kind(first), _by_kind(second))
    return _items(spark, d, 8).select(F.col("kind").cast("long").alias("kind"), F.col("n").cast("long").alias("n"), said.alias("said")).groupBy("kind", "n", "said").agg(F.count("*").alias("rows"))


@query("str20_latex_surface", "SELECT o_orderkey, [k::VARCHAR, '-' || k || '/2', k || ',' || k, '\\frac{' || k || '}{7}', 'Wednesday', k::VARCHAR, k::VARCHAR, k || '%'][1 + k % 8] surface FROM (SELECT o_orderkey, o_orderkey k FROM orders)")
def str20_surface(spark, d):
    k = F.col("o_orderkey")
    forms = ["$ %d\\text{ hours}. $", "\\phantom{+}-%d/2;", "%1$d\\text{, and } %1$d", "\\left\\dfrac{%d}{7}\\right", "\\text{Wednesday}", "%d_{8}", "\\$ %d\\mbox{ cm}^{2}", "%d\\!\\%%^\\circ"]
    spelled = F.lit(None).cast("string")
    for i, f in enumerate(forms):
        spelled = F.when(k % 8 == i, F.format_string(f, k) if "%" in f.replace("%%", "") else F.lit(f)).otherwise(spelled)
    return read_table(spark, d, "orders").select("o_orderkey", algebra.surface(spelled).alias("surface"))


@query("str22_vote_by_meaning", "SELECT l_orderkey, max(l_linenumber) votes, count(DISTINCT l_linenumber % 2) groups FROM (SELECT l_orderkey, l_linenumber % 2 l_p, l_linenumber % 2 l_linenumber0, count(*) OVER (PARTITION BY l_orderkey, l_linenumber % 2) l_linenumber FROM lineitem) GROUP BY 1".replace("count(DISTINCT l_linenumber % 2)", "count(DISTINCT l_p)"))
def vote(spark, d):
    """Answers of an order's lines, each spelled its own way, in groups of one meaning: by key, without comparing pairs."""
    n = F.col("l_linenumber").cast("int")
    spelled = F.when(n % 2 == 0, F.format_string("\\frac{%d}{%d}", n, 2 * n)).otherwise(F.format_string("\\sqrt{%d}\\cdot\\sqrt{%d}", 3 * n, n))
    value = F.when(n % 2 == 0, spelled).otherwise(F.concat(spelled, F.format_string("/%d", n)))
    keyed = read_table(spark, d, "lineitem").select("l_orderkey", algebra.expression_key(value).alias("key"))
    groups = keyed.groupBy("l_orderkey", "key").agg(F.count("*").alias("n"))
    return groups.groupBy("l_orderkey").agg(F.max("n").alias("votes"), F.count("*").alias("groups"))


@query(
    "str39_reference_answers",
    r"""SELECT o_orderkey, CASE WHEN k % 12 IN (0, 2, 4, 6, 8, 10) THEN NULL WHEN k % 12 IN (1, 3, 11) THEN 'final_answer does not match the public reference answer'
 WHEN k % 12 = 5 THEN 'final_answer does not match the public numerical reference answer' WHEN k % 12 IN (7, 9) THEN 'final_answer does not match the public competition-math reference answer' END reason
 FROM (SELECT o_orderkey, o_orderkey k FROM orders)""",
)
def str39(spark, d):
    """Every order as a task of some kind: right answers and wrong ones, among them one that names the reference and says that it isn't established."""
    k = F.col("o_orderkey")
    pick = lambda xs: F.element_at(F.array(*xs), (k % 12 + 1).cast("int"))
    kind = pick([F.lit(x) for x in ("multi_hop_qa", "multi_hop_qa", "science_multiple_choice", "multi_hop_qa", "math_word_problem", "math_word_problem", "competition_math", "competition_math", "competition_math", "competition_math", "essay", "synthetic_mechanism")])
    number, name = k.cast("string"), F.concat(F.lit("Order "), k.cast("string"))
    reference = pick([name, name, name, name, number, number, F.format_string("\\frac{%d}{2}+x", k), F.format_string("\\frac{%d}{2}", k), F.format_string("\\tan %d", k), F.format_string("\\tan %d", k), name, name])
    answer = pick(
        [name, F.concat(F.lit("The visible evidence names "), name, F.lit(" but does not state the clerk.")), F.concat(name, F.lit("; the visible evidence does not give the other one.")), F.lit("somebody else"), F.concat(F.lit("3 boxes of 7 make "), number),
         F.format_string("%d boxes, 2 more", k + 1), F.format_string("(%d+2x)/2", k), F.format_string("%d/3", k), F.lit("b"), F.lit("A"), F.lit("anything"), F.lit("Not established.")]
    )
    prompt = F.when(k % 12 > 7, F.format_string("Pick $\\textbf{(A)}\\ 5\\qquad \\textbf{(B)}\\ \\tan %d$", k)).otherwise(F.lit("What?"))
    rows = materialize(read_table(spark, d, "orders").select("o_orderkey", k.cast("string").alias("task_id"), kind.alias("task_kind"), reference.alias("reference_answer"), answer.alias("final_answer"), prompt.alias("prompt")), "answers")
    found = review.reference_reasons(rows.select("task_id", "task_kind", "prompt", "reference_answer"), rows.select("task_id", "final_answer"))
    return rows.join(found, "task_id", "left").select("o_orderkey", "reason")


@query(
    "w9_markers_in_frames",
    r"""WITH v AS (SELECT conv_id, turn, 'm' || (conv_id % 3) || ' item ' || (turn * 7 % 5) m, CASE WHEN turn % 3 = 0 THEN (conv_id * 10 + turn)::VARCHAR END number FROM conversations),
 f AS (SELECT conv_id, turn f_turn, 'note on m' || (conv_id % 3) || ' item ' || (turn % 5) || ', not m' || (conv_id % 3) || ' item ' || (turn % 5 + 1) || '0 but ' || (conv_id * 10 + turn + 1) || ',000 and ' || (conv_id * 10 + turn) || '.5' t, turn % 5 k, conv_id * 10 + turn + 1 n FROM conversations)
 SELECT conv_id, f_turn, turn FROM f JOIN v USING (conv_id) WHERE CASE WHEN turn % 3 = 0 THEN list_contains([conv_id % 3, k, (k + 1) * 10, n * 1000], conv_id * 10 + turn) ELSE turn * 7 % 5 = k END""",
)
def w9_markers(spark, d):
    """Every value of a conversation against every frame of it: words at boundaries, numbers as whole numbers with their commas."""
    c = read_table(spark, d, "conversations").select("conv_id", "turn")
    n = F.col("conv_id") * 10 + F.col("turn")
    value = c.select("conv_id", "turn", F.when(F.col("turn") % 3 == 0, n.cast("string")).otherwise(F.concat(F.lit("m"), (F.col("conv_id") % 3).cast("string"), F.lit(" item "), (F.col("turn") * 7 % 5).cast("string"))).alias("marker"))
    name = F.concat(F.lit("m"), (F.col("conv_id") % 3).cast("string"), F.lit(" item "))
    text = F.concat(F.lit("note on "), name, (F.col("turn") % 5).cast("string"), F.lit(", not "), name, (F.col("turn") % 5 + 1).cast("string"), F.lit("0 but "), (n + 1).cast("string"), F.lit(",000 and "), n.cast("string"), F.lit(".5"))
    frames = c.select("conv_id", F.col("turn").alias("f_turn"), text.alias("told"))
    return review.marker_hits(frames, value, "conv_id", "told", "marker").select("conv_id", "f_turn", "turn")


@query(
    "x1_arguments_and_contracts",
    r"""WITH k AS (SELECT l_orderkey o, l_linenumber n, min(l_partkey) p FROM lineitem GROUP BY 1, 2),
 r AS (SELECT CASE WHEN p % 5 = 0 THEN 'need n' || n || ' is missing required argument ''part''' WHEN p % 5 = 1 THEN 'evidence e' || n || ' is missing required argument ''part''' WHEN p % 5 = 2 THEN 'need n' || n || ' argument ''part'' does not match supplied evidence' END reason FROM k WHERE n <> 6
 UNION ALL SELECT CASE WHEN n = 7 THEN 'teacher need references unknown phase ''after:e7''' WHEN n = 6 THEN 'teacher need references unknown source ''s6''' WHEN n = 5 THEN 'teacher need target cell must exist in its activation phase' END FROM k)
 SELECT reason, count(*) n FROM r WHERE reason IS NOT NULL GROUP BY 1""",
)
def x1_contracts(spark, d):
    """A need and its evidence for every line of an order: arguments left out or changed, sources, phases and cells that aren't there."""
    line = read_table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"))
    task, n, p = F.col("l_orderkey").cast("string").alias("task_id"), F.col("l_linenumber").cast("string"), F.col("p")
    part = F.create_map(F.lit("part"), p.cast("string"), F.lit("note"), F.lit("x"))
    bare, other = F.create_map(F.lit("note"), F.lit("x")), F.create_map(F.lit("part"), F.concat(F.lit("0"), p.cast("string")))
    phase, cell = F.when(F.col("l_linenumber") == 7, "after:e7").otherwise("initial"), F.when(F.col("l_linenumber") == 5, "gone").otherwise("c1")
    asked, given = F.when(p % 5 == 0, bare).when(p % 5 == 2, other).otherwise(part), F.when(p % 5 == 1, bare).otherwise(part)
    rows = materialize(line.select(task, F.concat(F.lit("s"), n).alias("source"), F.concat(F.lit("e"), n).alias("evidence_id"), F.concat(F.lit("n"), n).alias("need_id"), phase.alias("phase"), cell.alias("cell_id"), asked.alias("asked"), given.alias("given")), "needs")
    needs, evidence = rows.drop("given").withColumnRenamed("asked", "arguments"), rows.select("task_id", "evidence_id", "source", F.col("given").alias("arguments"))
    arguments = F.array(F.struct(F.lit("part").alias("argument"), F.lit(True).alias("required")), F.struct(F.lit("note").alias("argument"), F.lit(False).alias("required")))
    tools = rows.filter("source <> 's6'").select("source").distinct().select("source", F.explode(arguments).alias("x")).select("source", "x.*")
    frames = rows.select("task_id", F.lit("initial").alias("phase")).distinct()
    found = review.argument_reasons(needs, evidence, tools).unionByName(review.contract_reasons(needs, evidence, tools, frames, frames.withColumn("cell_id", F.lit("c1"))))
    return found.groupBy("reason").agg(F.count("*").alias("n"))


@query("x7_reviewed_variants", r"SELECT o_orderkey, CASE WHEN k > 0 THEN k END::INT variant, CASE WHEN k > 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'Order ' || o_orderkey ELSE '\frac{' || 2 * o_orderkey || '}{2}' END END final_answer FROM (SELECT o_orderkey, o_orderkey % 6 k FROM orders)")
def x7_variants(spark, d):
    """Five variants of every order's answer, of which at most one is right: names for one half of the orders, fractions for the other."""
    o = read_table(spark, d, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("task_id"))
    k, v, odd = F.col("o_orderkey"), F.col("variant"), F.col("o_orderkey") % 2 == 1
    name = F.concat(F.lit("Order "), k.cast("string"))
    tasks = o.select("task_id", F.lit("?").alias("prompt"), F.when(odd, "competition_math").otherwise("multi_hop_qa").alias("task_kind"), F.when(odd, k.cast("string")).otherwise(name).alias("reference_answer"))
    right = v == k % 6
    answer = F.when(right & odd, F.format_string("\\frac{%d}{2}", 2 * k)).when(right, name).when(odd, F.format_string("\\frac{%d}{2}", 2 * k + v)).otherwise(F.lit("no such order"))
    variants = o.withColumn("variant", F.explode(F.sequence(F.lit(1), F.lit(5)))).select("task_id", "variant", answer.alias("final_answer"))
    return review.first_accepted(tasks, variants).select(F.col("task_id").cast("long").alias("o_orderkey"), "variant", "final_answer")
