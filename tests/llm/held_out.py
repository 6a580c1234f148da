"""Labelled lines in forms that the forest is not trained on: (text, secret or None)."""

import random
import string


def lines(n, seed):
    r = random.Random(seed)
    prose = "we found this in the config of that old server and nobody knows who wrote it so please look at once".split()
    w = lambda k=1: " ".join(r.choice(prose) for _ in range(k))
    some = lambda alphabet, k: "".join(r.choice(alphabet) for _ in range(k))
    alnum, hexa = string.ascii_letters + string.digits, "0123456789abcdef"
    syllables = "ka lo mi tu re sa ne po vi du".split()
    name = lambda k=3: "".join(r.choice(syllables) for _ in range(k))
    values = [
        lambda: some(hexa, 48), lambda: some(alnum, 21), lambda: some(alnum + "!#%&", 11), lambda: name().title() + some("!#$%&", 1) + some(string.digits, 4), lambda: some(string.digits, 24), lambda: some(alnum + "+/", 43) + "=",
        lambda: some(string.ascii_lowercase, 14), lambda: some(string.ascii_letters, 18), lambda: some(string.ascii_uppercase + string.digits, 26),
    ]
    yes = [
        "ENV DB_PASSWORD={v}", "set password for root = '{v}'", "mysql --password={v} -u root", "my_app.api_key: {v}", '{{"client": "x", "access_key": "{v}"}}', "login with password: {v} please", "TOKEN = `{v}`", "SECRET=\"{v}\" ./run.sh",
        "pwd={v};host=db", "the token is {v}", "spring.datasource.password={v}", "{w} private_key => {v}",
    ]
    bare = [lambda: "AKIA" + some(string.ascii_uppercase + string.digits, 16), lambda: "gho_" + some(alnum, 36), lambda: "sk_live_" + some(alnum, 30)]
    no = [
        lambda: f"Merge {some(hexa, 40)} into main", lambda: f"From {some(hexa, 40)} Mon Sep 17", lambda: f"docker pull app@sha256:{some(hexa, 64)}", lambda: f"ISBN-13: 978-0-{some(string.digits, 5)}-{some(string.digits, 3)}-1", lambda: f"released as {name()}-{r.randrange(9)}.{r.randrange(20)}-beta{r.randrange(9)}",
        lambda: f"<img src=data:image/gif;base64,R0lGODlhAQ{some(alnum, 30)}>", lambda: f"see http://{name()}.org/{name()}/{r.randrange(10**6)}/{name()}_{r.randrange(99)}", lambda: f"open /home/{name()}/{name()}2/{name()}_{r.randrange(999)}/{name()}.txt", lambda: f"session {some(hexa, 8)}-{some(hexa, 4)}-4{some(hexa, 3)}-a{some(hexa, 3)}-{some(hexa, 12)} ended",
        lambda: "password: enter your password", lambda: f"token = {name()}", lambda: "the secret is always patience", lambda: "api_key: <insert-your-key>", lambda: 'password = "********"', lambda: "password = getpass.getpass()", lambda: "token = request.headers['x']", lambda: "PASSWORD=${DB_PASSWORD}", lambda: "secret = config.secret.value",
        lambda: f"tracking number 1Z{some(string.ascii_uppercase + string.digits, 16)}", lambda: f"{name()}_{name()}_{r.randrange(9999)}.tar.gz", lambda: f"test_{name()}_returns_{r.randrange(99)}_rows", lambda: f"IBAN FR76{some(string.digits, 22)}", lambda: f"photo IMG_2023{some(string.digits, 4)}_{some(string.digits, 6)}", lambda: "password=example_password_1", lambda: "auth: required always",
    ]
    for k in range(n):
        if k % 9 == 8:
            v = r.choice(bare)()
            text = f"{w(2)} {v} {w(2)}"
        else:
            v = values[k % len(values)]()
            text = f"{w(r.randrange(3))} {r.choice(yes).format(v=v, w=w())} {w(r.randrange(3))}"
        yield text.strip(), v
        yield f"{w(r.randrange(3))} {no[k % len(no)]()} {w(r.randrange(3))}".strip(), None
