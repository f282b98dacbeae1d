"""Texts with characters that Unicode's and ASCII's classes see differently, between pieces that the rules rewrite."""

import random

ODD = [
    " ", "  ", "\n", "\t ", "\x0b", "\x0c", "\x1c", "\x1f", "\x85", "\xa0", "\u3000", "\u2009", "\u2028", "\u200b", "\ufb01", "①", "Ａ", "ｶﾞ", "é", "e\u0301", "１２３４", "٣", "😀", "ß", "ǆ", "ᾳ", "ŉ", "İ", "a", "x", "7",
    ". ", "! ", "? ", ".", "。", "。 ", "！", "．\u3000", "A.B@Mail.Example.COM", "q@x.Y.", "_", "-", "−", "/", "",
]
PIECES = {
    "jpn": ["2023年1月2日", "٢٠٢٣年1月2日", "令和5年3月4日", "平成12年3月4日", "¥ 0012345", "￥1234", "98765 円", "98765\xa0円", "株式含社", "有恨会社", "〒123 - 4567", "〒\u3000123-4567", "﹅"],
    "kor": ["2023년 1월 2일", "2023년\u30001월 2일", "2023-1-2", "2023.11.2", "2023/1/22", "٢2023/1/22", "₩ 12345", "₩\xa012345", "55555원", "(주) 식회사", "주 식\xa0회 사", "123 45 67890", "123\xa045 67890", "1234567890", "테스트 를", "테스트\xa0를", "테 로 은"],
    "eng": ["Jan 3, 2023", "Jéé 3, 2023", "éan 3, 2023", "Jan\xa03, 2023", "1/2/2023", "٣1/22/2023", "11/2/2023", "$ 12345", "$\xa012345", "00012345 USD", "12345\xa0USD", "Acme Inc", "Incé", "Corp.", "Ltd", "LLC.", "LLP", "limiled", "élimiled", "limiledé", "Ud.", "Ilc", "Ilć", "ßIlc"],
    "chi_sim": ["﹆", "３", "页", "。\n", "。\xa0"],
}


def odd_texts(seed, count, codes=tuple(PIECES)):
    rng = random.Random(seed)
    pieces = ODD + [p for c in codes for p in PIECES[c]]
    return [None, "", " \n ", "\xa0", " \u2028 ", "\u3000a\u3000", *("".join(rng.choice(pieces) for _ in range(rng.randint(0, 14))) for _ in range(count))]
