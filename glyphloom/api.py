"""Everything under one name, for grammars written against a flat interface."""

from .errors import *  # noqa: F403
from .functions.native import edit_distance, escape as escape_column, keypad, literal_rule, tag_terms
from .grammars.tagger import Tagger
from .labels import SymbolTable, default_token_type, escape, generated_symbols
from .operators.apply import candidates_of, exploded, register, register_scalar, rewrite
from .operators.arcs import ArcTable
from .operators.classes import add_weight, byte_class, delete, insert, join, regional_indicator, valid_utf8_char
from .operators.edit import EditTransducer, LevenshteinAutomaton, LevenshteinDistance, closest, distances
from .operators.machine import (
    ArcIterator, EncodeMapper, Machine as Fst, PathIterator, StateIterator, accep, arcmap, arcsort, closure, compile_lines, compose, concat, connect, cross, determinize, difference, disambiguate, epsnormalize, equal,
    equivalent, intersect, invert, isomorphic, items, leniently_compose, minimize, of_bytes, optimize, paths, priority_union, project, prune, push, randequivalent, randgen,
    relabel_pairs, relabel_tables, replace, reverse, reweight, rmepsilon, shortestdistance, shortestpath, statemap, string_map, synchronize, to_bytes, to_dot, to_lines, topsort, union,
)
from .operators.morphology import Category, Feature, FeatureVector, Paradigm, prefix, suffix, without_boundary
from .operators.pushdown import Parentheses
from .operators.relation import Relation
from .operators.rules import (
    Cascade, RewriteRule, RuleCascade, cdrewrite, lattice_to_dfa, lattice_to_nshortest, lattice_to_one_top_string, lattice_to_strings, lattice_to_top_string, matches, one_top_rewrite, optimal_rewrites, rewrite_lattice, rewrites, top_rewrite, top_rewrites,
)
from .semiring import LOG, LOG64, TROPICAL, Semiring, Weight, semiring
from .sources.archive import Archive as Far, Exporter
from .sources.lexicons import read_arc_text, read_parentheses, read_symbols, string_file, write_arc_text, write_parentheses, write_string_file, write_symbols
