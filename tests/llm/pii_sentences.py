"""Sentences with personal data, or with what looks like it, written by another grammar than the one that trains."""

import random

NAMES = ["anna", "j.meyer", "paul_k", "marie.dupont", "sales", "k.ito"]
HOSTS = ["example", "mail-server", "firma", "uni-bonn", "acme"]


def digits(rng, n):
    return "".join(str(rng.randrange(10)) for _ in range(n))


def luhn_ok(d):
    t = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        t += v - 9 * (v > 9)
    return t % 10 == 0


def sentence(rng):
    """(text, [(kind, item)] of what is personal in it)."""
    d = lambda n: digits(rng, n)
    kind = rng.choice(["phone_local", "email_spelled", "card_other", "iban", "ssn", "ipv6", None, None, None])
    if kind == "phone_local":
        item = rng.choice([f"0{d(2)} {d(7)}", f"0171 {d(7)}", f"({d(3)}) {d(3)}-{d(4)}", f"5{d(9)}", f"030/{d(7)}", f"{d(3)}-{d(3)}-{d(4)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{d(9)}"])
        return rng.choice([f"You can call her on {item} after six.", f"Sie erreichen uns unter Tel. {item}.", f"my mobile is {item}", f"Please ring: phone {item}, ask for Tom", f"Appelez le téléphone {item} demain", f"Fax: {item}\nthanks"]), [(kind, item)]
    if kind == "email_spelled":
        item = rng.choice(NAMES) + rng.choice([" (at) ", "[at]", " [at] ", "(at)"]) + rng.choice(HOSTS) + rng.choice([" (dot) ", ".", " dot ", " [dot] "]) + rng.choice(["com", "de", "org", "net"])
        return rng.choice([f"Send an email to {item} today.", f"Contact: {item}", f"you may write to {item}, or not"]), [(kind, item)]
    if kind == "card_other":
        size = rng.choice([13, 15, 16])
        body = d(size - 1)
        number = next(body + c for c in "0123456789" if luhn_ok(body + c))
        item = ".".join(number[i : i + 4] for i in range(0, size, 4)) if size == 16 else number if rng.random() < 0.5 else " ".join(number[i : i + 4] for i in range(0, size, 4))
        return rng.choice([f"He paid with his visa card {item} in May.", f"credit card: {item}.", f"Charge my mastercard {item}, please"]), [(kind, item)]
    if kind == "iban":
        body, country = d(18), rng.choice(["DE", "FR", "GB", "PL"])
        code = 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
        whole = f"{country}{code:02d}{body}"
        item = whole if rng.random() < 0.5 else " ".join(whole[i : i + 4] for i in range(0, 22, 4))
        return rng.choice([f"The bank account is {item} as before.", f"IBAN {item}", f"Please transfer it to {item}."]), [(kind, item)]
    if kind == "ssn":
        item = f"{d(3)}-{d(2)}-{d(4)}"
        return rng.choice([f"His SSN {item} was leaked.", f"social security number: {item}", f"Her social security no. is {item}."]), [(kind, item)]
    if kind == "ipv6":
        h = lambda: f"{rng.randrange(1 << 16):x}"
        item = rng.choice([f"2001:db8::{h()}", ":".join(h() for _ in range(8)), f"fe80::{h()}:{h()}:{h()}:{h()}", f"2a02:{h()}:{h()}::{h()}"])
        return rng.choice([f"The server listens on {item} now.", f"ping {item}", f"its IP address is {item}, I think"]), [(kind, item)]
    year = f"{rng.choice([19, 20])}{d(2)}"
    month, day = f"{rng.randint(1, 12):02d}", f"{rng.randint(1, 28):02d}"
    return rng.choice([
        f"Call on {year}-{month}-{day} at noon.", f"The phone bill of {day}.{month}.{year} is due.", f"Order {d(10)} has shipped.", f"See pages {d(3)}-{d(3)} of the report.",
        f"They met in {year}-{year[:2]}{d(2)}.", f"It costs 1 {d(3)} {d(3)} EUR.", f"ISBN 978-3-{d(2)}-{d(6)}-{d(1)} is out of print.", f"Meet me at home. we will see", f"use std::{rng.choice(['map', 'abc', 'face'])} there",
        f"at {d(2)}:{d(2)}:{d(2)} sharp", f"Part {d(3)}-{d(2)}-{d(4)} fits model {d(4)}-{d(4)}.", f"serial number {d(15)}", f"invoice {d(4)} {d(4)} {d(4)} {d(3)}", f"look at this.now please", f"version {d(2)}.{d(3)}.{d(2)}",
        f"call {year}-{month}-{day}", f"total {d(3)} {d(3)} {d(3)} rows",
    ]), []


def sentences(count, seed=77):
    rng = random.Random(seed)
    return [sentence(rng) for _ in range(count)]
