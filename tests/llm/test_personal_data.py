"""Spans that no base expression finds, on prose written by hand (not by the generator that the tagger learns from)."""

import re

from umbra.llm import pii, tagger

#: Spans are marked <<kind|text>>; those that the base expressions find are marked too.
PROSE = """
Please write to <<email|anna.berg (at) nordhafen.org>> if the parcel has not arrived by Monday.
My old address was <<email|tom_reed [at] riverside [dot] net>>, but nobody reads it any more.
You can reach our press office at <<email|press(at)museum-kiel.de>> or come by in person.
He signed the letter with <<email|j.moreau @ lumiere.fr>> and a small drawing of a cat.
For questions about the choir, contact <<email|chorleitung (at) stmarien dot de>> before the summer break.
Send the draft to <<email|editor@weekly-review.com>> and a copy to <<email|desk [at] weekly-review.com>>.
Escriba a <<email|reservas (at) hotelsol [dot] es>> para confirmar su habitación.
Merci d'envoyer vos photos à <<email|photos[at]association-velo.fr>> avant la fin du mois.
The garage can be called at <<phone|(312) 555-0188>> between nine and five.
Her number is <<phone|212-555-0143>>, and she asked you to ring after dinner.
If the alarm goes off again, dial <<phone|1-800-555-0199>> and ask for the night shift.
Sie erreichen die Praxis unter <<phone|030 5557788>> oder per Fax unter <<phone|030 5557789>>.
Mobil bin ich unter <<phone|0171 5550134>> fast immer zu erreichen.
Appelez le <<phone|01 55 50 12 34>> pour prendre rendez-vous avec le docteur.
Mon portable est le <<phone|06 55 50 98 76>>, mais je ne réponds pas le soir.
Llame al <<phone|655 501 234>> y pregunte por Lucía.
The London branch answers on <<phone|020 7946 0018>> and the one in Leeds has closed.
Text me on <<phone|415.555.0162>> when you land.
Call <<phone|+1 (415) 555-0100>> or, if it is late, <<phone|(415) 555-0101>>.
The card on file, <<card|4929 1234 5678 9012>>, was declined twice yesterday.
She read it out slowly: <<card|5500.0000.0000.0005>>, and then the date.
They charged <<card|4716/8821/0034/5567>> by mistake and promised a refund.
Visa <<card|4539578763621487>> is about to expire, please update it.
Paid with <<card|6011-1111-2222-3334>> at the counter on the second floor.
Meine Karte <<card|5212345678901235>> wurde am Automaten eingezogen.
Il a payé avec la carte <<card|4970 1012 3456 7891>> dans un magasin de Lyon.
Se cobró en la tarjeta <<card|4548.8120.4940.0005>> sin avisar a nadie.
The printer sits at <<ip|fe80::21a:2bff:fe3c:4d5e>> on the third floor.
Logs show a login from <<ip|2001:db8:85a3::8a2e:370:7334>> shortly after midnight.
The ticket mentions <<ip|10[.]20[.]30[.]40>> as the source of the scan.
Block <<ip|203[.]0[.]113[.]7>> and <<ip|198.51.100.23>> on the outer firewall.
Le serveur répond à l'adresse <<ip|2001:db8:0:42::1>> depuis ce matin.
Der Rechner mit der Adresse <<ip|fd12:3456:789a:1::1>> war gestern nicht zu erreichen.
In 1987 the bridge was rebuilt, and by 2004 some 12,500 cars crossed it every day.
Chapter 14 begins on page 233 and ends with a quotation from 1912.
Order 48821 was shipped on 2019-11-23 in two boxes of 12 and 18 bottles.
The train leaves at 14:35 and arrives at 18:02, with a stop of 7 minutes.
The recipe needs 250 g of flour, 3 eggs and 125 ml of milk.
Version 3.12.4 fixes 17 bugs, among them number 20931.
Die Strecke ist 42,195 km lang, der Rekord liegt bei 2:01:39.
Le prix est passé de 1 250 à 1 410 euros entre 2015 et 2018.
El equipo ganó por 3-1 ante 45.000 espectadores el 12.05.2016.
The commit 9fceb02d0ae598e95dc970b74767f19372d61af8 broke the build on Friday.
The network card has the address 00:1B:44:11:3A:B7 printed on its back.
The book, ISBN 978-0-14-044913-6, has been out of print since 1999.
Follow @nordhafen for news about the 25th regatta.
It cost $1,299.00 in 2008 and $849.50 a year later, a drop of 34.6%.
Room 1204 is on the 12th floor, next to the lift with the number 3.
See ISO 9001, section 4.3, and the note on page 118.
The match ended 6-4, 3-6, 7-5 after 2:48 hours.
The valley lies at 1,860 m, and the hut (built in 1931) at 2,410 m.
Invoice 2021-00457 over 318,40 Euro is due on 30.09.2021.
"""


def marked(line):
    text, spans, at = "", [], 0
    for m in re.finditer(r"<<(\w+)\|(.*?)>>", line):
        text += line[at : m.start()]
        spans.append((tagger.KINDS.index(m.group(1)), len(text), len(text) + len(m.group(2))))
        text, at = text + m.group(2), m.end()
    return text + line[at:], spans


def test_spans_beyond_the_base_on_text_of_another_source():
    lines = [marked(x) for x in PROSE.strip().split("\n")]
    right = made = gold = 0
    for (text, spans), (base, every) in zip(lines, pii.all_spans([t for t, _ in lines], tagger.trained()), strict=True):
        want, added = set(spans) - set(base), set(every) - set(base)
        right, made, gold = right + len(want & added), made + len(added), gold + len(want)
        for s in want ^ added:
            print("missed" if s in want else "wrong", tagger.KINDS[s[0]], repr(text[s[1] : s[2]]), "in", text)
    print(right, made, gold)
    assert gold >= 30 and right / made >= 0.9 and right / gold >= 0.9


def test_long_regions_are_cut_without_losing_spans():
    unit = "1 22 333 " * 100  # no gap of more than a few characters without a digit
    text = unit * 12 + "call (415) 555-0100 now " + unit * 12 + "mail x.y (at) zed.org " + unit
    cuts = tagger.regions(tagger.codes(text))
    assert len(cuts) > 4 and max(b - a for a, b, _, _ in cuts) <= tagger.LONGEST + tagger.OVERLAP
    assert [c[2] for c in cuts[1:]] == [c[3] for c in cuts[:-1]] and cuts[-1][3] == len(text)
    short = "1 22 333 1 22 333 call (415) 555-0100 now 1 22 333 1 22 333"
    near = {short[a:b] for _, a, b, _ in tagger.tagged(tagger.trained(), [short])[0]}
    found = {text[a:b] for _, a, b, _ in tagger.tagged(tagger.trained(), [text])[0]}
    assert "(415) 555-0100" in near and "(415) 555-0100" in found
