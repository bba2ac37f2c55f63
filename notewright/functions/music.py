"""Constants of the note representation and the column expressions built on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Durations in subbeats by index, the drum program, the markers of a dense roll.
DURATIONS = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128, 192, 256, 384, 512, 768, 1024, 1536, 2048, 3072, 4096)
DRUM_PROGRAM = 127
END_OF_STEP = 254
PAD = 255

#: Midpoints between neighbouring durations; a value on a midpoint takes the shorter one.
BOUNDARIES = tuple((a + b) / 2 for a, b in zip(DURATIONS, DURATIONS[1:], strict=False))

# Token layout without and with velocity.
PITCHES = 128
NORMAL_TOKENS = len(DURATIONS) * PITCHES + 256
VELOCITY_TOKENS = len(DURATIONS) * PITCHES + PITCHES * 16
SOS, EOS, PAD_TOKEN = NORMAL_TOKENS, NORMAL_TOKENS + 1, NORMAL_TOKENS + 2

SUBBEATS = 4


def step_of(time: Column) -> Column:
    """The subbeat nearest to a time; halves go to the even one."""
    return F.bround(time).cast("int")


def duration_index(subbeats: Column) -> Column:
    """Index of the duration nearest to a length in subbeats."""
    bounds = F.array(*[F.lit(b) for b in BOUNDARIES])
    return F.size(F.filter(bounds, lambda b: b < subbeats))


def duration_subbeats(index: Column) -> Column:
    return F.get(F.array(*[F.lit(d) for d in DURATIONS]), index)


def recoded_program(program: Column, is_drum: Column) -> Column:
    return F.when(is_drum, F.lit(DRUM_PROGRAM)).otherwise(program)


def off_beat(step: Column, division: int = SUBBEATS) -> Column:
    """Whether a step lies on an odd subbeat of its beat."""
    return F.pmod(step, F.lit(division)) % 2 == 1


def on_group(step: Column, group: int = 4) -> Column:
    return F.pmod(step, F.lit(group)) == 0


def keyed_unit(*parts: Column | str) -> Column:
    """A number in [0, 1) that depends on its key alone: 32 bits of the key's MD5."""
    key = F.concat_ws(":", *[(F.lit(p) if isinstance(p, str) else p.cast("string")) for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") / F.lit(float(2**32))


def shrink_duration(value: Column, by: int) -> Column:
    """Lowers a duration index, not below 0; pads stay."""
    return F.when(value < PAD, F.greatest(value, F.lit(by)) - by).otherwise(value)


def close_to(a: Column, b: Column) -> Column:
    """Whether a equals b within 1e-8 plus 1e-5 of b."""
    return F.abs(a - b) <= F.lit(1e-8) + F.lit(1e-5) * F.abs(b)


# Cody's rational approximations of erf below ERF_SPLIT and of erfc above it (numerators
# and denominators, highest power first); their error is below 1e-15.
ERF_SPLIT = 0.46875
ERF_P = (1.85777706184603153e-1, 3.16112374387056560, 1.13864154151050156e2, 3.77485237685302021e2, 3.20937758913846947e3)
ERF_Q = (1.0, 2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3, 2.84423683343917062e3)
ERFC_P = (
    2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594, 6.61191906371416295e1, 2.98635138197400131e2, 8.81952221241769090e2,
    1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3,
)
ERFC_Q = (
    1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2, 1.62138957456669019e3, 3.29079923573345963e3,
    4.36261909014324716e3, 3.43936767414372164e3, 1.23033935480374942e3,
)


def _polynomial(x: Column, coefficients: tuple[float, ...]) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def erf(x: Column) -> Column:
    """The error function of a double, to within 1e-10, as a native expression; null and NaN stay."""
    size = F.least(F.abs(x), F.lit(6.0))  # from 6 on it is 1
    small = x * _polynomial(x * x, ERF_P) / _polynomial(x * x, ERF_Q)
    rest = F.exp(-size * size) * _polynomial(size, ERFC_P) / _polynomial(size, ERFC_Q)
    return F.when(F.isnan(x), x).when(F.abs(x) <= ERF_SPLIT, small).otherwise(F.signum(x) * (1.0 - rest))


def gelu(x: Column) -> Column:
    """The exact GELU: x times the share of a standard normal that lies below it."""
    return x * 0.5 * (1.0 + erf(x / 2.0**0.5))
