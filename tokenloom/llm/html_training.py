"""Trains the weights of ``html_blocks`` on pages that this module makes up; ``python -m tokenloom.llm.html_training``.

A made-up page is a random arrangement of named parts (menus, headers, adverts, notices, sidebars, forms, comments, footers,
articles) in varied markup, so every block's label is known from the part it was made for.
"""

from __future__ import annotations

import html
import random
import sys

import numpy as np

from .html_blocks import HIDDEN, INPUT, WEIGHTS, BiLSTM, blocks_of, features

SYLLABLES = "an en in on er es ti re th he nd ou ed or st ha le ai ch de un que ción mente ra do ga ung keit sch ver ein au ß ö é è ñ í".split()
#: A block's label rides along as a character of the private use area in front of its text.
YES, NO = "\ue000", "\ue001"


def word(r: random.Random) -> str:
    return "".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4)))


def sentence(r: random.Random, low: int, high: int) -> str:
    words = [word(r) for _ in range(r.randint(low, high))]
    kind = r.random()
    if kind < 0.05:
        words = [w + r.choice(("***", "&&&", "%%%", "###", "$$$")) for w in words]
    elif kind < 0.08:
        words = [w.upper() + "!!" for w in words]
    elif kind < 0.1:
        words = [w + " |" for w in words]
    return html.escape(" ".join(words).capitalize() + r.choice((".", ".", ".", "", "?", ",")), quote=False)


def paragraph(r: random.Random) -> str:
    text = " ".join(sentence(r, 2, 24) for _ in range(r.choice((1, 1, 2, 3, 6))))
    if r.random() < 0.15:
        text += f' <a href="/{word(r)}">{word(r)} {word(r)}</a> {word(r)}.'
    if r.random() < 0.15:
        text = f"<{(t := r.choice(('b', 'em', 'strong', 'i')))}>{text}" + (f"</{t}>" if r.random() < 0.5 else "<br>")
    return text


def attribute(r: random.Random, *names: str) -> str:
    if not names or r.random() < 0.15:
        return ""
    name = r.choice(names)
    if r.random() < 0.4:
        name += r.choice(("-box", "-1", " wide", "_main", " clear", "-wrap"))
    return f' {r.choice(("class", "class", "id"))}="{name}"'


def links(r: random.Random, label: str) -> str:
    n = r.randint(1, 9)
    items = [f'<a href="/{word(r)}">{label}{" ".join(word(r) for _ in range(r.randint(1, 3)))}</a>' for _ in range(n)]
    if r.random() < 0.7:
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
    return "".join(f"<div>{x}</div>" for x in items) if r.random() < 0.5 else "<p>" + " | ".join([items[0], *(x.replace(label, "") for x in items[1:])]) + "</p>"


def some(r: random.Random, label: str, n: int, tags=("p", "div", "span")) -> str:
    out = ""
    for _ in range(n):
        tag = r.choice(tags)
        text = sentence(r, 1, 20)
        out += f"<{tag}>{label}{text}</{tag}>" if tag != "span" else f"<div><span>{label}{text}</span></div>"
    return out


def menu(r):
    tag, a = r.choice((("nav", attribute(r, "nav", "menu", "top")), ("nav", ""), ("div", f' class="{r.choice(("menu", "nav", "navbar", "breadcrumbs", "navigation"))}"'), ("ul", ' class="menu"')))
    return f"<{tag}{a}>{links(r, NO)}</{tag}>"


def header(r):
    body = (f"<h1>{NO}{sentence(r, 1, 4)}</h1>" if r.random() < 0.4 else "") + (some(r, NO, 1) if r.random() < 0.7 else "") + (menu(r) if r.random() < 0.5 else "")
    return f"<header>{body}</header>" if r.random() < 0.6 else f'<div class="{r.choice(("header", "site-header", "masthead", "top-bar"))}">{body}</div>'


def advert(r):
    tag = r.choice(("div", "div", "section", "aside", "p"))
    name = r.choice(("ad", "ad", "ad", "ads", "advert", "advertisement", "banner", "sponsored", "promo", "ad-slot"))
    inner = NO + sentence(r, 1, 14) if tag == "p" or r.random() < 0.6 else some(r, NO, r.randint(1, 3))
    return f'{"<!-- ad -->" if r.random() < 0.4 else ""}<{tag} {r.choice(("class", "class", "id"))}="{name}">{inner}</{tag}>'


def notice(r):
    name = r.choice(("cookie", "cookie-notice", "notice", "consent", "alert", "gdpr", "popup", "modal", "newsletter", "subscribe", "paywall"))
    button = f"<button>{NO}{word(r)}</button>" if r.random() < 0.5 else ""
    return f'<div {r.choice(("class", "id"))}="{name}">{some(r, NO, r.randint(1, 3))}{button}</div>'


def sidebar(r):
    body = (f"<h3>{NO}{sentence(r, 1, 4)}</h3>" if r.random() < 0.6 else "") + (links(r, NO) if r.random() < 0.6 else some(r, NO, r.randint(1, 4)))
    return f"<aside{attribute(r, 'sidebar', 'side', 'related')}>{body}</aside>" if r.random() < 0.6 else f'<div class="{r.choice(("sidebar", "side", "related", "widget", "recommended", "share", "social", "tags"))}">{body}</div>'


def form(r):
    body = "".join(f"<label>{NO}{word(r)}</label><input name=q>" if r.random() < 0.6 else f"<p>{NO}{sentence(r, 1, 8)}</p>" for _ in range(r.randint(1, 3))) + f"<button>{NO}{word(r)}</button>"
    if r.random() < 0.3:
        body += "<select>" + "".join(f"<option>{NO}{word(r)}</option>" for _ in range(3)) + "</select>"
    return f"<form{attribute(r, 'search', 'login', 'signup', 'contact')}>{body}</form>"


def comments(r):
    item = r.choice(("div", "li", "article", "p"))
    body = "".join(f'<{item} class="{r.choice(("comment", "reply", "comment-body"))}">{NO + paragraph(r) if item == "p" or r.random() < 0.5 else some(r, NO, r.randint(1, 3), ("p", "div"))}</{item}>' for _ in range(r.randint(1, 5)))
    title = f"<h3>{NO}{sentence(r, 1, 3)}</h3>" if r.random() < 0.6 else ""
    tag = r.choice(("div", "section", "ol"))
    return f'<{tag} {r.choice(("class", "id"))}="{r.choice(("comments", "comment-list", "discussion", "responses", "disqus-thread"))}">{title}{body}</{tag}>'


def footer(r):
    body = f"{NO}&copy; {word(r)}.example.com &middot; {sentence(r, 1, 12)}" if r.random() < 0.6 else some(r, NO, r.randint(1, 3)) + (links(r, NO) if r.random() < 0.5 else "")
    return f"<footer>{body}</footer>" if r.random() < 0.7 else f'<div class="{r.choice(("footer", "site-footer", "copyright", "legal"))}">{body}</div>'


def article(r):
    title = f"<h1>{YES}{sentence(r, 1, 10)}</h1>" if r.random() < 0.85 else ""
    body, inner = "", ""
    for _ in range(r.choice((0, 1, 2, 3, 5, 8, 12, 20)) + (not title)):
        kind = r.random()
        if kind < 0.74:
            body += f"<p>{YES}{paragraph(r)}" + ("</p>" if r.random() < 0.85 else "")
        elif kind < 0.82:
            body += f"<h{(k := r.randint(2, 4))}>{YES}{sentence(r, 1, 7)}</h{k}>"
        elif kind < 0.87:
            body += "<ul>" + "".join(f"<li>{YES}{sentence(r, 1, 12)}</li>" for _ in range(r.randint(2, 5))) + "</ul>"
        elif kind < 0.9:
            body += f"<blockquote>{YES}{paragraph(r)}</blockquote>"
        elif kind < 0.92:
            body += "<table>" + "".join(f"<tr><td>{YES}{word(r)}</td><td>{YES}{word(r)}</td></tr>" for _ in range(2)) + "</table>"
        elif kind < 0.94:
            body += f"<pre>{YES}{sentence(r, 2, 12)}</pre>"
        elif kind < 0.96:
            body += f"<figure><figcaption>{YES}{sentence(r, 2, 9)}</figcaption></figure>"
        else:
            inner = r.choice((advert, notice, sidebar, form))(r)
            body += inner
    end = comments(r) if r.random() < 0.08 else ""
    if r.random() < 0.15:
        end += f'<div class="{r.choice(("share", "social", "tags", "related"))}">{links(r, NO)}</div>'
    kind = r.random()
    if kind < 0.55:
        return f"<article{attribute(r, 'post', 'entry', 'story') if r.random() < 0.4 else ''}>{title}{body}{end}</article>"
    if kind < 0.7:
        return f"<main>{title}{body}{end}</main>"
    if kind < 0.93:
        name = r.choice(("content", "post", "entry-content", "article", "article-body", "story", "main", "text", "body"))
        return f'<div {r.choice(("class", "id"))}="{name}">{title}{body}{end}</div>'
    return f"<div>{title}{body}</div>{end}" if r.random() < 0.5 else title + body + end


def page(r: random.Random) -> str:
    before = [f(r) for f, p in ((menu, 0.7), (header, 0.4), (notice, 0.2), (advert, 0.5), (form, 0.15), (sidebar, 0.2)) if r.random() < p]
    after = [f(r) for f, p in ((advert, 0.15), (sidebar, 0.3), (comments, 0.3), (form, 0.15), (notice, 0.1)) if r.random() < p]
    r.shuffle(before)
    r.shuffle(after)
    foot = [footer(r)] if r.random() < 0.85 else []
    text = f"<!DOCTYPE html><html><head><meta charset=utf-8><title>{word(r)}</title><style>p{{margin:0}}</style></head><body>" + "".join(before + [article(r)] + after + foot)
    return text + ("</body></html>" if r.random() < 0.85 else "")


def labelled(text: str) -> tuple[np.ndarray, np.ndarray]:
    blocks = blocks_of(text)
    y = np.array([b.text.lstrip(" ").startswith(YES) for b in blocks], dtype=np.float32)
    for b in blocks:
        b.text = b.text.replace(YES, "").replace(NO, "").strip() or "."
    return features(blocks), y


def gradients(model: BiLSTM, x, mask, y):
    """Loss and gradients by backpropagation through time."""
    w, H = model.w, HIDDEN
    time, size, _ = x.shape
    kept = {d: [] for d in "fb"}
    h = np.concatenate([model.direction(x, mask, d, kept[d]) for d in "fb"], axis=2)
    z = h @ w["o"] + w["d"]
    p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    n = mask.sum()
    loss = -(mask * (y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7))).sum() / n
    dz = mask * (p - y) / n
    g = {"o": np.einsum("tb,tbh->h", dz, h), "d": np.array([dz.sum()])}
    for k, d in enumerate("fb"):
        dout = dz[:, :, None] * w["o"][k * H : (k + 1) * H]
        dgates = np.zeros((time, size, 4 * H), np.float32)
        gh = np.zeros_like(w["h" + d])
        dh, dc = np.zeros((size, H), np.float32), np.zeros((size, H), np.float32)
        for t, h0, c0, s, u, new, m in reversed(kept[d]):
            dh = dh + dout[t]
            th = np.tanh(new)
            dnew = m * (dc + dh * s[:, 2 * H :] * (1 - th * th))
            ds = np.concatenate((dnew * u, dnew * c0, m * dh * th), axis=1) * s * (1 - s)
            dg = np.concatenate((ds, dnew * s[:, :H] * (1 - u * u)), axis=1)
            dgates[t] = dg
            gh += h0.T @ dg
            dh = dg @ w["h" + d].T + (1 - m) * dh
            dc = dnew * s[:, H : 2 * H] + (1 - m) * dc
        flat = dgates.reshape(time * size, -1)
        g["x" + d], g["h" + d], g["c" + d] = x.reshape(time * size, -1).T @ flat, gh, flat.sum(axis=0)
    return loss, g


def train(n_pages: int = 3000, epochs: int = 5, seed: int = 5, rate: float = 4e-3) -> BiLSTM:
    r = random.Random(seed)
    data = [labelled(page(r)) for _ in range(n_pages)]
    data = sorted((d for d in data if len(d[1])), key=lambda d: len(d[1]))
    batches = [data[i : i + 24] for i in range(0, len(data), 24)]
    model, step = BiLSTM.new(), 0
    first = {k: np.zeros_like(v) for k, v in model.w.items()}
    second = {k: np.zeros_like(v) for k, v in model.w.items()}
    for epoch in range(epochs):
        r.shuffle(batches)
        losses = []
        for batch in batches:
            longest = max(len(y) for _, y in batch)
            x, mask, y = np.zeros((longest, len(batch), INPUT), np.float32), np.zeros((longest, len(batch)), np.float32), np.zeros((longest, len(batch)), np.float32)
            for j, (a, b) in enumerate(batch):
                x[: len(b), j], mask[: len(b), j], y[: len(b), j] = a, 1, b
            loss, g = gradients(model, x, mask, y)
            losses.append(loss)
            step += 1
            for k, v in g.items():
                v = np.clip(v, -1, 1)
                first[k] += 0.1 * (v - first[k])
                second[k] += 0.001 * (v * v - second[k])
                lr = rate * (1 - step / (epochs * len(batches) + 1)) + 1e-4
                model.w[k] -= (lr * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        print(f"epoch {epoch + 1}: loss {np.mean(losses):.4f}", file=sys.stderr, flush=True)
    return model


def accuracy(model: BiLSTM, n_pages: int = 300, seed: int = 99) -> float:
    """Of the blocks of held-out made-up pages."""
    r = random.Random(seed)
    data = [labelled(page(r)) for _ in range(n_pages)]
    marks = model.labels([x for x, _ in data])
    return sum(int((m == (y > 0.5)).sum()) for m, (_, y) in zip(marks, data, strict=True)) / sum(len(y) for _, y in data)


if __name__ == "__main__":
    trained = train()
    print("held-out accuracy", accuracy(trained))
    np.savez_compressed(WEIGHTS, **{k: v.astype(np.float16) for k, v in trained.w.items()})
