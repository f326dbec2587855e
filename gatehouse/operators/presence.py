"""Rules on whether a field is there, which look at other fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.typesys import ACCEPTED, DECLINED, all_of, any_of, empty, one_of, same_as
from .checks import accepted, declined
from .registry import rule


def _is(c, other, value):
    """The other field is there and strictly equals the value."""
    o = c.other(str(other))
    return o.present & same_as(o, value)


def _there(c, other):
    o = c.other(other)
    return o.present & ~empty(o)


def _present(c, other):
    return c.other(other).present


def _full(c):
    return ~empty(c.value)


@rule("required_if", 2, "The {field} field is required when {0} is {1}.")
def required_if(c, other, value, *ignored):
    return ~_is(c, other, value) | _full(c)


@rule("required_unless", 2, "The {field} field is required unless {0} is {1}.")
def required_unless(c, other, value, *ignored):
    return _is(c, other, value) | _full(c)


@rule("required_with", 2, "The {field} field is required when {all} is present.", text_params=True)
def required_with(c, *fields):
    return ~any_of(_there(c, f) for f in fields) | _full(c)


@rule("required_with_all", 2, "The {field} field is required when {all} are present.", text_params=True)
def required_with_all(c, *fields):
    return ~all_of(_there(c, f) for f in fields) | _full(c)


@rule("required_without", 2, "The {field} field is required when {all} is not present.", text_params=True)
def required_without(c, *fields):
    return all_of(_there(c, f) for f in fields) | _full(c)


@rule("required_without_all", 2, "The {field} is required when none of {all} are present.", text_params=True)
def required_without_all(c, *fields):
    return any_of(_there(c, f) for f in fields) | _full(c)


@rule("required_if_accepted", 2, "The {field} is required when {0} is accepted.", text_params=True)
def required_if_accepted(c, other):
    return ~(_present(c, other) & one_of(c.other(other), ACCEPTED)) | _full(c)


@rule("required_if_declined", 2, "The {field} is required when {0} is declined.", text_params=True)
def required_if_declined(c, other):
    return ~(_present(c, other) & one_of(c.other(other), DECLINED)) | _full(c)


@rule("present", 1, "The {field} must be present.")
def present(c):
    return c.value.present


@rule("present_if", 2, "The {field} must be present when {0} is {1}.")
def present_if(c, other, value):
    return ~_is(c, other, value) | c.value.present


@rule("present_unless", 2, "The {field} must be present unless {0} is {1}.")
def present_unless(c, other, value):
    return _is(c, other, value) | c.value.present


@rule("present_with", 2, "The {field} must be present when any of {all} are present.", text_params=True)
def present_with(c, *fields):
    return ~any_of(_present(c, f) for f in fields) | c.value.present


@rule("present_with_all", 2, "The {field} must be present when all of {all} are present.", text_params=True)
def present_with_all(c, *fields):
    return ~all_of(_present(c, f) for f in fields) | c.value.present


def _absent(c):
    return ~c.value.present | empty(c.value)


@rule("missing", 1, "The {field} must not be present.")
def missing(c):
    return _absent(c)


@rule("missing_if", 2, "The {field} must not be present when {0} is {1}.")
def missing_if(c, other, value):
    return ~_is(c, other, value) | _absent(c)


@rule("missing_unless", 2, "The {field} must not be present unless {0} is {1}.")
def missing_unless(c, other, value):
    return _is(c, other, value) | _absent(c)


@rule("prohibited", 1, "The {field} field is prohibited.")
def prohibited(c):
    return empty(c.value)


@rule("prohibited_if", 2, "The {field} field is prohibited when {0} is {1}.")
def prohibited_if(c, other, value, *ignored):
    return ~_is(c, other, value) | empty(c.value)


@rule("prohibited_unless", 2, "The {field} is prohibited unless {0} is {1}.")
def prohibited_unless(c, other, value, *ignored):
    return _is(c, other, value) | empty(c.value)


@rule("prohibits", 2, "The {field} prohibits {all} from being present.", text_params=True)
def prohibits(c, *fields):
    return empty(c.value) | all_of(~_there(c, f) for f in fields)


@rule("accepted_if", 2, "The {field} must be accepted when {0} is {1}.")
def accepted_if(c, other, value):
    return ~_is(c, other, value) | accepted(c)


@rule("declined_if", 2, "The {field} must be declined when {0} is {1}.")
def declined_if(c, other, value):
    return ~_is(c, other, value) | declined(c)


# Exclusions: the predicate says that the field stays.


@rule("exclude", 1, "The {field} will be excluded from validated data.", kind="exclude")
def exclude(c):
    return F.lit(False)


@rule("exclude_if", 2, "The {field} will be excluded when {0} is {1}.", kind="exclude")
def exclude_if(c, other, value):
    return ~_is(c, other, value)


@rule("exclude_unless", 2, "The {field} will be excluded unless {0} is {1}.", kind="exclude")
def exclude_unless(c, other, value):
    return _is(c, other, value)


@rule("exclude_with", 2, "The {field} will be excluded when {0} is present.", kind="exclude", text_params=True)
def exclude_with(c, other):
    return ~_present(c, other)


@rule("exclude_without", 2, "The {field} will be excluded when {0} is not present.", kind="exclude", text_params=True)
def exclude_without(c, other):
    return _present(c, other)
