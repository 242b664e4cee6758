"""Context-dependent rewrite rules tau / L __ R over an alphabet.

A site is a span of the input that tau rewrites.  A derivation picks disjoint sites and
copies the rest; both contexts hold at every picked site.  Where the contexts are tested
depends on the direction: `ltr` tests L on the output made so far and R on the input, `rtl`
the other way round from the end, `sim` both on the input.  `obl` also demands that no
place outside of picked sites is left at which a site could have been picked; `opt` does
not.  The result is the set of all outputs, with the least weight of each.

A rule is compiled once on the driver and sent to the tasks; they walk each string with the
set of context states, so the work is linear in the string as long as outputs do not fork.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass
from functools import cached_property

from ..errors import ArgumentError, RewriteError
from ..labels import BOS, EOS, EPSILON, to_labels, to_text
from ..semiring import FINE_DELTA, INFINITY
from .machine import Machine, determinize, items, machine, minimize, of_labels, project, prune, reverse, rmepsilon, shortestpath, union

DIRECTIONS, MODES = ("ltr", "rtl", "sim"), ("obl", "opt")
MOST_OUTPUTS = 10_000


class Acceptor:
    """Sets of states of an epsilon-free acceptor."""

    def __init__(self, m: Machine):
        m = rmepsilon(m)
        self.start = frozenset() if m.start is None else frozenset([m.start])
        self.finals = frozenset(m.finals)
        self.next: list[dict[int, frozenset]] = []
        for arcs in m.arcs:
            to = defaultdict(set)
            for a in arcs:
                to[a.ilabel].add(a.to)
            self.next.append({k: frozenset(v) for k, v in to.items()})
        self._memo: dict = {}

    def step(self, states: frozenset, label: int) -> frozenset:
        key = states, label
        if key not in self._memo:
            self._memo[key] = frozenset().union(*(self.next[s].get(label, ()) for s in states))
        return self._memo[key]

    def step_from_anywhere(self, states: frozenset, label: int) -> frozenset:
        """As if any text could stand before."""
        return self.step(states | self.start, label)

    def accepts(self, states: frozenset) -> bool:
        return not self.finals.isdisjoint(states)

    def accepts_all(self, labels) -> bool:
        states = self.start
        for x in labels:
            states = self.step(states, x)
        return self.accepts(states)


def writing_cycles(m: Machine) -> frozenset[int]:
    """States where a cycle that reads nothing and writes something begins."""
    silent = {s: [a for a in m.arcs[s] if a.ilabel == EPSILON] for s in m.states()}

    def reaches(s: int, goal: int) -> bool:
        seen, todo = {s}, [s]
        while todo:
            t = todo.pop()
            if t == goal:
                return True
            for a in silent[t]:
                if a.to not in seen:
                    seen.add(a.to)
                    todo.append(a.to)
        return False

    return frozenset(s for s, arcs in silent.items() for a in arcs if a.olabel and reaches(a.to, s))


def _completes(m: Machine, s: int, x, j: int, ends) -> bool:
    """Whether a walk from state s at place j of x gets to a final state at a place where ends(place)."""
    seen, todo = {(s, j)}, [(s, j)]
    while todo:
        s, j = todo.pop()
        if s in m.finals and ends(j):
            return True
        for a in m.arcs[s]:
            k = j if a.ilabel == EPSILON else j + 1
            if (k == j or j < len(x) and x[j] == a.ilabel) and (a.to, k) not in seen:
                seen.add((a.to, k))
                todo.append((a.to, k))
    return False


def _reversed(m: Machine) -> Machine:
    return reverse(m)


@dataclass(frozen=True, eq=False)
class RewriteRule:
    """tau may be a machine or text; contexts and alphabet are unweighted acceptors."""

    tau: Machine
    left: Machine
    right: Machine
    sigma_star: Machine
    direction: str = "ltr"
    mode: str = "obl"

    def __post_init__(self):
        if self.direction not in DIRECTIONS:
            raise ArgumentError(f"unknown direction: {self.direction}")
        if self.mode not in MODES:
            raise ArgumentError(f"unknown mode: {self.mode}")
        for what, m in (("left context", self.left), ("right context", self.right), ("alphabet", self.sigma_star)):
            kind = m.properties()
            if not (kind["acceptor"] and kind["unweighted"]):
                raise ArgumentError(f"the {what} is not an unweighted acceptor")

    # -- compiled parts; rtl is ltr on reversed machines

    @cached_property
    def _backward(self) -> bool:
        return self.direction == "rtl"

    @cached_property
    def _tau(self) -> Machine:
        return rmepsilon(_reversed(self.tau) if self._backward else self.tau)

    @cached_property
    def _endless(self) -> frozenset[int]:
        return writing_cycles(self._tau)

    @cached_property
    def _before(self) -> Acceptor:
        return Acceptor(_reversed(self.right) if self._backward else self.left)

    @cached_property
    def _after(self) -> Acceptor:
        return Acceptor(self.left if self._backward else _reversed(self.right))

    @cached_property
    def _sigma(self) -> Acceptor:
        return Acceptor(self.sigma_star)

    def __getstate__(self):
        _ = self._tau, self._endless, self._before, self._after, self._sigma, self._backward
        return self.__dict__

    def __setstate__(self, state):
        self.__dict__.update(state)

    # -- application

    def _sites(self, x: list[int], i: int, after_ok: list[bool]) -> list[tuple[int, tuple[int, ...], float]]:
        """(end, output, weight) of the sites that start at i and whose right context holds; the least weight of each."""
        tau = self._tau
        if tau.start is None:
            return []
        found: dict[tuple, float] = {}
        todo = [(tau.start, i, (), 0.0)]
        seen: dict[tuple, float] = {}
        while todo:
            s, j, out, w = todo.pop()
            if seen.get((s, j, out), INFINITY) <= w:
                continue
            if s in self._endless:
                if _completes(tau, s, x, j, lambda k: after_ok[k]):
                    raise RewriteError("a rule writes without end")
                continue
            seen[s, j, out] = w
            if s in tau.finals and after_ok[j]:
                key = j, out
                found[key] = min(found.get(key, INFINITY), w + tau.finals[s])
            for a in tau.arcs[s]:
                o = out + ((a.olabel,) if a.olabel else ())
                if a.ilabel == EPSILON:
                    todo.append((a.to, j, o, w + a.weight))
                elif j < len(x) and x[j] == a.ilabel:
                    todo.append((a.to, j + 1, o, w + a.weight))
        return [(j, o, w) for (j, o), w in found.items()]

    def outputs(self, labels: list[int]) -> dict[tuple[int, ...], float]:
        """All outputs with their least weights; none if the alphabet does not have the input."""
        if not self._sigma.accepts_all(labels):
            return {}
        x = labels[::-1] if self._backward else list(labels)
        first, last = (EOS, BOS) if self._backward else (BOS, EOS)
        n = len(x)
        # the far context, read from the end: does it hold for what follows place j?
        states = self._after.step_from_anywhere(self._after.start, last)
        after_ok = [False] * (n + 1)
        after_ok[n] = self._after.accepts(states | self._after.start)
        for j in range(n - 1, -1, -1):
            states = self._after.step_from_anywhere(states, x[j])
            after_ok[j] = self._after.accepts(states | self._after.start)
        near = self._before
        origin = near.step_from_anywhere(near.start, first)
        sites = [self._sites(x, i, after_ok) for i in range(n + 1)]
        # (place, state of the near context, inserted here?) -> output -> weight
        layers: list[dict] = [defaultdict(dict) for _ in range(n + 2)]
        layers[0][origin, False][()] = 0.0
        on_output = self.direction != "sim"
        prefix = [origin]
        for c in x:
            prefix.append(near.step_from_anywhere(prefix[-1], c))

        def put(i: int, key, out, w) -> None:
            have = layers[i][key]
            if w < have.get(out, INFINITY):
                have[out] = w
                if len(have) > MOST_OUTPUTS:
                    raise RewriteError(f"more than {MOST_OUTPUTS} outputs")

        result: dict[tuple[int, ...], float] = {}
        for i in range(n + 1):
            done = False
            while not done:
                # insertions stay at their place, so a place is walked until it gives nothing new
                done = True
                for (states, inserted), outs in list(layers[i].items()):
                    fits = near.accepts((states if on_output else prefix[i]) | near.start)
                    here = sites[i] if fits else []
                    todo, layers[i][states, inserted] = dict(outs), {}
                    for out, w in todo.items():
                        for j, made, v in here:
                            if j == i and inserted:
                                continue
                            to = states
                            if on_output:
                                for c in made:
                                    to = near.step_from_anywhere(to, c)
                            else:
                                to = origin
                            put(j, (to, j == i), out + made, w + v)
                            done = done and j != i
                        if here and self.mode == "obl" and not inserted:
                            continue
                        if i == n:
                            result[out] = min(result.get(out, INFINITY), w)
                        else:
                            put(i + 1, (near.step_from_anywhere(states, x[i]) if on_output else origin, False), out + (x[i],), w)
        return {out[::-1]: w for out, w in result.items()} if self._backward else result

    def candidates(self, text: str, kind=None) -> list[tuple[str, float]]:
        """(output, weight), best first."""
        made = self.outputs(to_labels(text, kind))
        return sorted(((to_text(o, kind), w) for o, w in made.items()), key=lambda x: (x[1], x[0]))


def cdrewrite(tau, left, right, sigma_star, direction: str = "ltr", mode: str = "obl") -> RewriteRule:
    """A rule; texts are compiled, '' is the empty context."""
    return RewriteRule(machine(tau), machine(left), machine(right), machine(sigma_star), direction, mode)


# ---------------------------------------------------------------- rewriting single texts


class Cascade:
    """Rules applied one after the other; anything with `outputs(labels)` or a machine may be a rule."""

    def __init__(self, *rules):
        self.rules = rules

    def outputs(self, labels) -> dict[tuple[int, ...], float]:
        now = {tuple(labels): 0.0}
        for rule in self.rules:
            after: dict[tuple[int, ...], float] = {}
            for x, w in now.items():
                for y, v in outputs_of(rule, list(x)).items():
                    after[y] = min(after.get(y, INFINITY), w + v)
            now = after
        return now

    candidates = RewriteRule.candidates


class _Lattice:
    """Composition of one string with a machine, walked without building the product."""

    def __init__(self, m: Machine):
        self.m, self.endless = m, writing_cycles(m)

    def outputs(self, labels) -> dict[tuple[int, ...], float]:
        m, n = self.m, len(labels)
        if m.start is None:
            return {}
        best: dict[tuple, float] = {(0, m.start, ()): 0.0}
        todo, result = [(0, m.start, ())], {}
        while todo:
            key = todo.pop()
            i, s, out = key
            w = best[key]
            if s in self.endless:
                if _completes(m, s, labels, i, lambda k: k == n):
                    raise RewriteError("endless outputs")
                continue
            if i == n and s in m.finals:
                result[out] = min(result.get(out, INFINITY), w + m.finals[s])
            for a in m.arcs[s]:
                if a.ilabel == EPSILON:
                    to = (i, a.to, out + ((a.olabel,) if a.olabel else ()))
                elif i < n and labels[i] == a.ilabel:
                    to = (i + 1, a.to, out + ((a.olabel,) if a.olabel else ()))
                else:
                    continue
                if len(best) > 100 * MOST_OUTPUTS:
                    raise RewriteError(f"more than {100 * MOST_OUTPUTS} partial outputs")
                if w + a.weight < best.get(to, INFINITY) - 1e-12:
                    best[to] = w + a.weight
                    todo.append(to)
        return result


def outputs_of(rule, labels: list[int]) -> dict[tuple[int, ...], float]:
    return (_Lattice(rule) if isinstance(rule, Machine) else rule).outputs(labels)


# ---------------------------------------------------------------- outputs as a machine


def rewrite_lattice(text: str, rule, kind=None) -> Machine:
    """All outputs of a text as an acceptor without epsilons; none is an error."""
    made = outputs_of(rule, to_labels(text, kind))
    if not made:
        raise RewriteError(f"no output for {text!r}")
    return rmepsilon(union(*[of_labels(o, weight=w) for o, w in made.items()]))


def lattice_to_dfa(lattice: Machine, optimal_only: bool = False, state_multiplier: int = 4) -> Machine:
    """One path a string, or only the best strings; an error above 256 + state_multiplier * states."""
    most = 256 + state_multiplier * lattice.num_states()
    found = determinize(project(lattice, "output"), nstate=most)
    return minimize(prune(found, 0.0) if optimal_only else found)


def lattice_to_nshortest(lattice: Machine, nshortest: int) -> Machine:
    """The n best different strings."""
    return shortestpath(project(lattice, "output"), nshortest, unique=True)


def lattice_to_strings(lattice: Machine, kind=None) -> list[str]:
    """All strings, best first, then in the order of their texts."""
    best: dict[str, float] = {}
    for _, o, w in items(lattice, kind):
        best[o] = min(best.get(o, INFINITY), w)
    return sorted(best, key=lambda o: (best[o], o))


def lattice_to_top_string(lattice: Machine, kind=None) -> str:
    """The best string, the first by its text where several tie."""
    found = lattice_to_strings(lattice_to_dfa(lattice, optimal_only=True), kind)
    if not found:
        raise RewriteError("an empty lattice has no string")
    return found[0]


def lattice_to_one_top_string(lattice: Machine, kind=None) -> str:
    """The best string; several are an error."""
    found = lattice_to_strings(lattice_to_dfa(lattice, optimal_only=True), kind)
    if len(found) != 1:
        raise RewriteError(f"several best outputs: {found[0]}, {found[1]}" if found else "an empty lattice has no string")
    return found[0]


# ---------------------------------------------------------------- outputs as texts


def _candidates(text: str, rule, kind=None) -> list[tuple[str, float]]:
    made = outputs_of(rule, to_labels(text, kind))
    if not made:
        raise RewriteError(f"no output for {text!r}")
    return sorted(((to_text(o, kind), w) for o, w in made.items()), key=lambda x: (x[1], x[0]))


def rewrites(text: str, rule, kind=None) -> list[str]:
    return [o for o, _ in _candidates(text, rule, kind)]


def top_rewrites(text: str, rule, n: int, kind=None) -> list[str]:
    return rewrites(text, rule, kind)[:n]


def top_rewrite(text: str, rule, kind=None) -> str:
    return rewrites(text, rule, kind)[0]


def optimal_rewrites(text: str, rule, kind=None) -> list[str]:
    found = _candidates(text, rule, kind)
    return [o for o, w in found if w <= found[0][1] + FINE_DELTA]


def one_top_rewrite(text: str, rule, kind=None) -> str:
    found = optimal_rewrites(text, rule, kind)
    if len(found) > 1:
        raise RewriteError(f"several best outputs of {text!r}: {found[0]}, {found[1]}")
    return found[0]


def matches(itext: str, otext: str, rule, kind=None) -> bool:
    return tuple(to_labels(otext, kind)) in outputs_of(rule, to_labels(itext, kind))


class RuleCascade:
    """Rules of an archive, chosen by name and applied in order."""

    def __init__(self, archive):
        self.archive, self.cascade = archive, None

    def set_rules(self, names) -> None:
        missing = [n for n in names if n not in self.archive]
        if missing:
            raise ArgumentError(f"unknown rule: {missing[0]}")
        self.cascade = Cascade(*[self.archive[n] for n in names])

    def _rules(self):
        if self.cascade is None or not self.cascade.rules:
            raise ArgumentError("no rules were set")
        return self.cascade

    def matches(self, itext: str, otext: str, kind=None) -> bool:
        return matches(itext, otext, self._rules(), kind)

    def rewrites(self, text: str, kind=None) -> list[str]:
        return rewrites(text, self._rules(), kind)

    def top_rewrites(self, text: str, n: int, kind=None) -> list[str]:
        return top_rewrites(text, self._rules(), n, kind)

    def top_rewrite(self, text: str, kind=None) -> str:
        return top_rewrite(text, self._rules(), kind)

    def one_top_rewrite(self, text: str, kind=None) -> str:
        return one_top_rewrite(text, self._rules(), kind)

    def optimal_rewrites(self, text: str, kind=None) -> list[str]:
        return optimal_rewrites(text, self._rules(), kind)
