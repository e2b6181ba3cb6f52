"""Table functions for SQL: questions and texts to rows, by LATERAL.

    register(spark)
    SELECT q.id, c.* FROM questions q, LATERAL plan_conditions(q.question) c
    SELECT d.id, t.* FROM documents d, LATERAL split_tokens(d.text, 320, 50) t

Null questions and texts give no rows.  Arguments are checked when a query is
analysed, so a wrong one is an error before anything runs."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, IntegerType, IntegralType, NullType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from gleaner.operators import chunking, planner

def _rows(**kinds: DataType) -> StructType:
    out = StructType()
    for name, kind in kinds.items():
        out = out.add(name, kind)
    return out


CONDITION = _rows(ord=IntegerType(), field=StringType(), op=StringType(), num_value=DoubleType(), bool_value=BooleanType(), str_value=StringType(), text=StringType())
SPAN = _rows(c_no=IntegerType(), c_start=IntegerType(), c_end=IntegerType(), piece=StringType())


def _is(argument: AnalyzeArgument, name: str, *kinds: type) -> None:
    if not isinstance(argument.dataType, (*kinds, NullType)):
        raise TypeError(f"{name} can't be {argument.dataType.simpleString()}")


def _count(argument: AnalyzeArgument, name: str, least: int) -> int:
    _is(argument, name, IntegralType)
    if not argument.isConstantExpression or argument.value is None or argument.value < least:
        raise ValueError(f"{name} must be a constant of {least} at least")
    return argument.value


@F.udtf
class PlanConditions:
    """Conditions of a question, and maybe the vendors that are known: ord, field, op,
    num_value, bool_value, str_value, text."""

    @staticmethod
    def analyze(question: AnalyzeArgument, vendors: AnalyzeArgument | None = None) -> AnalyzeResult:
        _is(question, "question", StringType)
        if vendors is not None:
            _is(vendors, "vendors", ArrayType)
        return AnalyzeResult(CONDITION)

    def eval(self, question: str | None, vendors: list | None = None):
        for c in planner.plan(question, None if vendors is None else [v for v in vendors if v]):
            yield tuple(c[f] for f in planner.FIELDS)


@F.udtf
class SplitTokens:
    """Pieces of a text of at most so many tokens, which overlap by so many: c_no from
    1, c_start, c_end (half-open, code points), piece."""

    @staticmethod
    def analyze(text: AnalyzeArgument, size: AnalyzeArgument, overlap: AnalyzeArgument) -> AnalyzeResult:
        _is(text, "text", StringType)
        if _count(overlap, "overlap", 0) >= _count(size, "size", 1):
            raise ValueError("overlap must be less than size")
        return AnalyzeResult(SPAN)

    def eval(self, text: str | None, size: int, overlap: int):
        for i, (a, b) in enumerate(chunking.split_spans(text or "", chunking.Budget(size, overlap)), 1):
            yield i, a, b, text[a:b]


@F.udtf
class RecursiveSpans:
    """Pieces of at most so many tokens, cut at the coarsest separator that does."""

    @staticmethod
    def analyze(text: AnalyzeArgument, size: AnalyzeArgument) -> AnalyzeResult:
        _is(text, "text", StringType)
        _count(size, "size", 1)
        return AnalyzeResult(SPAN)

    def eval(self, text: str | None, size: int):
        for i, (a, b) in enumerate(chunking.recursive_spans(text or "", size), 1):
            yield i, a, b, text[a:b]


FUNCTIONS = {"plan_conditions": PlanConditions, "split_tokens": SplitTokens, "recursive_spans": RecursiveSpans}


def register(spark: SparkSession) -> None:
    """Makes the table functions known to the session's SQL."""
    for name, function in FUNCTIONS.items():
        spark.udtf.register(name, function)
