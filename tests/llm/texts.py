"""Inputs of the tests."""

#: Texts that break careless code: null, empty, blank, odd white space, other scripts, control signs.
ODD = [None, "", "   ", "a", "\t x \n", "a  b \n c", "ab", "İstanbul ΣΑΣ é ́x 😀", "<|endoftext|> hi",
       "it's we'll 'S 123 4", "▁ a▁", "\x00 nul", "long " * 3000, "x" * 5000, "1 2 3 4 5 6 7 8 9 " * 300, "日本語 テキスト"]
