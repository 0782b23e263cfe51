"""A character-level bidirectional LSTM with a CRF on top, in numpy: tags, training, decoding."""

from __future__ import annotations

import random
from dataclasses import dataclass
from functools import cache

import numpy as np

KINDS = ("email", "ip", "card", "phone")
#: Tag 0 is outside; kind k starts with tag 1 + 2k and goes on with 2 + 2k.
TAGS = 1 + 2 * len(KINDS)
WINDOW = 80
#: Character classes: printable ASCII each, then white space, other letters, other digits, anything else, beyond the end.
CLASSES = 95 + 5
EMBED, HIDDEN = 12, 24
_FORBIDDEN = -1e4


def classes(text: str) -> np.ndarray:
    """Class of each code point."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4")
    out = np.where((points >= 32) & (points < 127), points - 32, 95).astype(np.int16)
    for at in np.flatnonzero(points >= 127).tolist():
        char = text[at]
        out[at] = 95 if char.isspace() else 96 if char.isalpha() else 97 if char.isdigit() else 98
    return out


@dataclass
class Tagger:
    """Both directions' weights lie in one array each, the forward one first."""

    embed: np.ndarray  # CLASSES, EMBED
    inputs: np.ndarray  # 2, EMBED, 4 * HIDDEN: input, forget, output gate, candidate
    states: np.ndarray  # 2, HIDDEN, 4 * HIDDEN
    bias: np.ndarray  # 2, 1, 4 * HIDDEN
    out: np.ndarray  # 2 * HIDDEN, TAGS
    out_bias: np.ndarray
    moves: np.ndarray  # TAGS, TAGS: from, to
    first: np.ndarray

    @staticmethod
    def random(seed: int) -> Tagger:
        r = np.random.default_rng(seed)
        draw = lambda scale, *shape: (r.standard_normal(shape) * scale).astype(np.float32)
        bias = np.zeros((2, 1, 4 * HIDDEN), np.float32)
        bias[:, :, HIDDEN : 2 * HIDDEN] = 1
        return Tagger(draw(0.5, CLASSES, EMBED), draw(EMBED**-0.5, 2, EMBED, 4 * HIDDEN), draw(HIDDEN**-0.5, 2, HIDDEN, 4 * HIDDEN), bias, draw(HIDDEN**-0.5, 2 * HIDDEN, TAGS), np.zeros(TAGS, np.float32), np.zeros((TAGS, TAGS), np.float32), np.zeros(TAGS, np.float32))

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, self.inputs, self.states, self.bias, self.out, self.out_bias, self.moves, self.first]

    def run(self, ids: np.ndarray, keep: bool = False):
        """Emissions (batch, time, tag) of windows of class ids; with keep, also what going back needs."""
        batch, time = ids.shape
        both = np.stack([ids, ids[:, ::-1]])
        table = np.matmul(self.embed[None], self.inputs) + self.bias  # 2, CLASSES, gates
        h = c = np.zeros((2, batch, HIDDEN), np.float32)
        hs, kept = np.empty((time, 2, batch, HIDDEN), np.float32), []
        for t in range(time):
            gates = np.matmul(h, self.states)
            gates[0] += table[0][both[0, :, t]]
            gates[1] += table[1][both[1, :, t]]
            s = 1 / (1 + np.exp(-gates[..., : 3 * HIDDEN]))
            g = np.tanh(gates[..., 3 * HIDDEN :])
            before = (h, c)
            c = s[..., HIDDEN : 2 * HIDDEN] * c + s[..., :HIDDEN] * g
            e = np.tanh(c)
            h = s[..., 2 * HIDDEN :] * e
            hs[t] = h
            if keep:
                kept.append((before, s, g, e))
        features = np.concatenate([hs[:, 0], hs[::-1, 1]], axis=2).transpose(1, 0, 2)
        emissions = features @ self.out + self.out_bias
        return (emissions, features, both, kept) if keep else emissions


@cache
def allowed() -> tuple[np.ndarray, np.ndarray]:
    """What is added to moves and first: a kind goes on only after itself."""
    moves, first = np.zeros((TAGS, TAGS), np.float32), np.zeros(TAGS, np.float32)
    for k in range(len(KINDS)):
        on = 2 + 2 * k
        first[on] = _FORBIDDEN
        moves[:, on] = _FORBIDDEN
        moves[on - 1, on] = moves[on, on] = 0
    return moves, first


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def viterbi(net: Tagger, emissions: np.ndarray) -> np.ndarray:
    """Best tags (batch, time)."""
    more, start = allowed()
    moves, best = net.moves + more, net.first + start + emissions[:, 0]
    back = []
    for t in range(1, emissions.shape[1]):
        every = best[:, :, None] + moves[None]
        back.append(every.argmax(axis=1))
        best = every.max(axis=1) + emissions[:, t]
    tags = [best.argmax(axis=1)]
    for came in reversed(back):
        tags.append(np.take_along_axis(came, tags[-1][:, None], axis=1)[:, 0])
    return np.stack(tags[::-1], axis=1)


def loss_and_gradients(net: Tagger, ids: np.ndarray, tags: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean negative log-likelihood of the tags under the CRF, and its gradients."""
    emissions, features, both, kept = net.run(ids, keep=True)
    more, start = allowed()
    moves, first = net.moves + more, net.first + start
    batch, time, _ = emissions.shape
    alpha, beta = np.empty_like(emissions), np.zeros_like(emissions)
    alpha[:, 0] = first + emissions[:, 0]
    for t in range(1, time):
        alpha[:, t] = _logsumexp(alpha[:, t - 1, :, None] + moves[None], 1) + emissions[:, t]
    for t in range(time - 2, -1, -1):
        beta[:, t] = _logsumexp(moves[None] + (emissions[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
    total = _logsumexp(alpha[:, -1], 1)
    rows, times = np.arange(batch)[:, None], np.arange(time)[None]
    right = emissions[rows, times, tags].sum(axis=1) + first[tags[:, 0]] + moves[tags[:, :-1], tags[:, 1:]].sum(axis=1)
    marginal = np.exp(alpha + beta - total[:, None, None])
    pairs = alpha[:, :-1, :, None] + moves + (emissions[:, 1:] + beta[:, 1:])[:, :, None, :] - total[:, None, None, None]
    d_moves = np.exp(pairs).sum(axis=(0, 1))
    np.subtract.at(d_moves, (tags[:, :-1], tags[:, 1:]), 1)
    d_emissions = marginal
    d_emissions[rows, times, tags] -= 1
    d_emissions /= batch
    d_out = np.tensordot(features, d_emissions, axes=([0, 1], [0, 1]))
    d_features = d_emissions @ net.out.T
    d_hs = np.stack([d_features[:, :, :HIDDEN], d_features[:, ::-1, HIDDEN:]])  # 2, batch, time, HIDDEN
    d_h = d_c = np.zeros((2, batch, HIDDEN), np.float32)
    d_states, d_gates_all = np.zeros_like(net.states), np.empty((time, 2, batch, 4 * HIDDEN), np.float32)
    for t in range(time - 1, -1, -1):
        (h0, c0), s, g, e = kept[t]
        i, f, o = s[..., :HIDDEN], s[..., HIDDEN : 2 * HIDDEN], s[..., 2 * HIDDEN :]
        d_h = d_h + d_hs[:, :, t]
        d_c = d_c + d_h * o * (1 - e * e)
        d = d_gates_all[t]
        d[..., :HIDDEN] = d_c * g * i * (1 - i)
        d[..., HIDDEN : 2 * HIDDEN] = d_c * c0 * f * (1 - f)
        d[..., 2 * HIDDEN : 3 * HIDDEN] = d_h * e * o * (1 - o)
        d[..., 3 * HIDDEN :] = d_c * i * (1 - g * g)
        d_states += np.matmul(h0.transpose(0, 2, 1), d)
        d_h, d_c = np.matmul(d, net.states.transpose(0, 2, 1)), d_c * f
    d_bias = d_gates_all.sum(axis=(0, 2))[:, None]
    d_table = np.zeros((2, CLASSES, 4 * HIDDEN), np.float32)
    for way in (0, 1):
        np.add.at(d_table[way], both[way].T.ravel(), d_gates_all[:, way].reshape(-1, 4 * HIDDEN))
    d_inputs = np.matmul(net.embed.T[None], d_table)
    d_embed = np.matmul(d_table, net.inputs.transpose(0, 2, 1)).sum(axis=0)
    d_first = (marginal[:, 0]).sum(axis=0)
    grads = [d_embed, d_inputs, d_states, d_bias, d_out, d_emissions.sum(axis=(0, 1)), d_moves / batch, d_first]
    return float((total - right).mean()), grads


def fit(windows: np.ndarray, tags: np.ndarray, epochs: int = 4, batch: int = 48, rate: float = 8e-3, seed: int = 5) -> Tagger:
    """Adam over windows of class ids (n, WINDOW) and their tags."""
    net, r = Tagger.random(seed), np.random.default_rng(seed)
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parameters()]
    step, steps = 0, epochs * -(-len(windows) // batch)
    for _ in range(epochs):
        order = r.permutation(len(windows))
        for at in range(0, len(order), batch):
            step += 1
            rows = order[at : at + batch]
            _, grads = loss_and_gradients(net, windows[rows].astype(np.intp), tags[rows].astype(np.intp))
            norm = float(np.sqrt(sum(float((g * g).sum()) for g in grads)))
            clip, lr = min(1.0, 5.0 / (norm + 1e-9)), rate * (1 - step / (steps + 1))
            for p, g, (m, v) in zip(net.parameters(), grads, state, strict=True):
                g = g * clip
                m += 0.1 * (g - m)
                v += 0.005 * (g * g - v)
                p -= (lr * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.995**step)) + 1e-6)).astype(np.float32)
    return net


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choices("0123456789", k=n))


def _word(r: random.Random) -> str:
    word = "".join(r.choice(("th", "er", "on", "an", "in", "le", "re", "st", "en", "ou", "ch", "ment", "ción", "ung", "é", "è", "ñ", "ö", "ß", "a", "e", "o", "s", "d")) for _ in range(r.randint(1, 4)))
    return r.choice((word, word, word, word.capitalize(), word.upper())) + r.choice(("", "", "", "", ".", ",", "!!", "###", "***", ":"))


def _email(r: random.Random) -> str:
    local = r.choice((".", "_", "", "+")).join(_word(r).strip(".,!#*:").lower() or "x" for _ in range(r.randint(1, 2)))
    local += r.choice(("", _digits(r, 2), "." + _digits(r, 2)))
    at = r.choice(("@", "@", "@", " @ "))
    return local + at + ".".join(r.choices(("mail", "mail7", "example", "site", "post-box", "corp"), k=r.randint(1, 2))) + r.choice((".com", ".org", ".net", ".de", ".co.uk"))


def _phone(r: random.Random) -> str:
    a, b, c = _digits(r, 3), r.choice(("555", _digits(r, 3))), _digits(r, 4)
    return r.choice((f"+1 ({a}) {b}-{c}", f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{_digits(r, 2)} {a} {b} {c}", f"+{_digits(r, 2)}{a}{b}{c}", f"1-{a}-{b}-{c}"))


def _ip(r: random.Random) -> str:
    return ".".join(str(r.randint(0, 255)) for _ in range(4))


def _card(r: random.Random) -> str:
    four = [_digits(r, 4) for _ in range(4)]
    return r.choice(("", "", " ", "-", ".", "/")).join(four) if r.random() < 0.85 else f"{four[0]} {four[1]}{four[2][:2]} {four[3]}{four[2][2:]}{r.choice('0123456789')}"


def _decoy(r: random.Random) -> str:
    return r.choice((
        f'token = "{"".join(r.choices("0123456789abcdef", k=40))}"', f"{r.randint(1900, 2030)}", f"{r.randint(1, 28)}.{r.randint(1, 12)}.{r.randint(1980, 2030)}", f"{r.randint(1980, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}",
        f"{r.randint(0, 23)}:{r.randint(0, 59):02}", f"{r.randint(0, 99)}.{_digits(r, 2)}", f"{r.randint(1, 999)},{_digits(r, 3)},{_digits(r, 3)}", f"v{r.randint(0, 9)}.{r.randint(0, 30)}.{r.randint(0, 30)}", _digits(r, r.randint(1, 12)),
        f"${r.randint(1, 9999)}.{_digits(r, 2)}", f"CC BY-NC {r.randint(1, 4)}.0", f"{r.randint(1, 99)} + {r.randint(1, 99)}", f"#{_digits(r, r.randint(3, 9))}", f"{r.randint(1, 99)}%", f"@{_word(r)}", f"{_digits(r, 3)}-{_digits(r, 2)}", "".join(r.choices("0123456789abcdef", k=r.randint(8, 32))),
    ))


def examples(n: int, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """n labelled windows: invented words with values of each kind, and with numbers that are none."""
    r, ids, tags = random.Random(seed), np.empty((n, WINDOW), np.int16), np.zeros((n, WINDOW), np.int16)
    for row in range(n):
        text, marks = "", []
        while len(text) < 2 * WINDOW:
            pick = r.random()
            gap = r.choice((" ", " ", " ", " | ", "\n"))
            if pick < 0.16:
                kind = r.randrange(len(KINDS))
                value = (_email, _ip, _card, _phone)[kind](r)
                marks.append((kind, len(text), len(text) + len(value)))
                text += value + r.choice(("", "", "", ".", ",")) + gap
            elif pick < 0.26:
                text += _decoy(r) + gap
            else:
                text += _word(r) + gap
        at = r.randrange(WINDOW // 2)
        found, tag = classes(text), np.zeros(len(text), np.int16)
        for kind, start, end in marks:
            tag[start] = 1 + 2 * kind
            tag[start + 1 : end] = 2 + 2 * kind
        ids[row], tags[row] = found[at : at + WINDOW], tag[at : at + WINDOW]
        if tags[row, 0] and tags[row, 0] % 2 == 0:
            tags[row, 0] -= 1
    return ids, tags


@cache
def trained(n: int = 5000, epochs: int = 4, seed: int = 3) -> Tagger:
    """The tagger that the PII operator uses by default, trained once a process, the same each time."""
    return fit(*examples(n, seed), epochs=epochs)
