"""Names of techniques, attacks, directions and forms with their spellings, and words that mark prose."""

from __future__ import annotations

SPELLINGS = {
    "technique": {
        "ikkyo": ["ikkajo"], "nikyo": ["nikajo"], "sankyo": ["sankajo"], "yonkyo": ["yonkajo"], "gokyo": [], "shiho-nage": ["shionage"],
        "kote-gaeshi": ["kotegaeshi"], "irimi-nage": ["iriminage"], "kaiten-nage": ["kaitennage"], "kokyu-nage": ["kokyunage", "kokyonage"],
        "kokyu-ho": ["kokyuho", "kokyudosa"], "tenchi-nage": ["tenchinage"], "koshi-nage": ["koshinage"], "juji-garami": ["jujigarami", "jujinage"],
        "aiki-otoshi": ["aikiotoshi"], "sumi-otoshi": ["sumiotoshi"], "kaiten-osae": ["kaitenosae"],
        "hiji-kime-osae": ["hijikimeosae", "udekimeosae", "ude-kime-osae"], "ude-garami": ["udegarami"], "kokyu-tanden-ho": ["kokyutandenho"],
    },
    "attack": {
        "katate-dori": ["katatedori", "katatekosadori", "kosadori"], "ryote-dori": ["ryotedori"], "morote-dori": ["morotedori", "katatemorotedori"],
        "kata-dori": ["katadori"], "mune-dori": ["munedori", "muna-dori", "munadori"], "ushiro-ryote-dori": ["ushiroryotedori"],
        "ushiro-eri-dori": ["ushiroeridori"], "ushiro-kubishime": ["ushirokubishime"], "ushiro-dori": ["ushirodori"], "shomen-uchi": ["shomenuchi"],
        "yokomen-uchi": ["yokomenuchi"], "tsuki": ["chudantsuki", "jodantsuki", "tski"], "kata-dori-men-uchi": ["katadorimenuchi"],
    },
    "direction": {"omote": [], "ura": []},
    "form": {
        "suwari-waza": ["suwariwaza", "suwari"], "hanmi-handachi": ["hanmihandachi", "handachi"], "tachi-waza": ["tachiwaza"], "tachi-dori": ["tachidori"],
        "jo-dori": ["jodori"], "tanto-dori": ["tantodori", "tantotori"], "jo-nage": ["jonage"], "buki-waza": ["bukiwaza"], "kumitachi": ["kumitachi"],
        "kumijo": ["kumijo"], "ken-tai-jo": ["kentaijo"], "ki-no-nagare": ["kinonagare"], "kihon": ["kihon"],
    },
}

KANJI = {
    "technique": {
        "ikkyo": ["第一教", "一教", "一ヶ条"], "nikyo": ["第二教", "二教", "二ヶ条"], "sankyo": ["第三教", "三教", "三ヶ条"], "yonkyo": ["第四教", "四教", "四ヶ条"],
        "gokyo": ["第五教", "五教", "五ヶ条"], "shiho-nage": ["四方投げ", "四方投"], "kote-gaeshi": ["小手返し", "小手返"],
        "irimi-nage": ["入身投げ", "入り身投げ", "入身投"], "kaiten-nage": ["回転投げ", "回転投"], "kokyu-nage": ["呼吸投げ", "呼吸投"], "kokyu-ho": ["呼吸法"],
        "tenchi-nage": ["天地投げ", "天地投"], "koshi-nage": ["腰投げ", "腰投"], "juji-garami": ["十字絡み", "十字投げ"], "sumi-otoshi": ["隅落とし", "隅落し"],
        "aiki-otoshi": ["合気落とし", "合気落し"],
    },
    "attack": {
        "katate-dori": ["片手取り", "片手取"], "ryote-dori": ["両手取り", "両手取"], "morote-dori": ["諸手取り", "諸手取"], "kata-dori": ["肩取り", "肩取"],
        "mune-dori": ["胸取り", "胸取"], "ushiro-ryote-dori": ["後ろ両手取り", "後両手取り"], "ushiro-dori": ["後ろ取り", "後取り"], "shomen-uchi": ["正面打ち", "正面打"],
        "yokomen-uchi": ["横面打ち", "横面打"], "tsuki": ["突き"],
    },
    "direction": {"omote": ["表"], "ura": ["裏"]},
    "form": {
        "suwari-waza": ["座り技", "坐り技", "座技", "居取り"], "hanmi-handachi": ["半身半立", "半身半立ち"], "tachi-dori": ["太刀取り", "太刀取"],
        "jo-dori": ["杖取り", "杖取"], "tanto-dori": ["短刀取り", "短刀取"],
    },
}

PROSE = (
    "the", "a", "an", "and", "or", "of", "is", "are", "was", "were", "as", "to", "in", "on", "at", "with", "for", "this", "that", "these", "those",
    "you", "your", "his", "her", "its", "it", "he", "she", "they", "we", "because", "have", "has", "had", "will", "would", "can", "could", "when",
    "while", "then", "than", "from", "by", "but", "so", "if", "refer", "page", "see", "exercise", "explained", "consistently", "receive", "opponent",
    "there", "here", "which", "who", "what", "how", "why", "into", "about", "also", "been", "being", "one", "two", "techniques", "technique",
    "through", "again", "pointers", "regarding", "case", "counteraction", "against", "develop", "conversely", "instance", "control", "remarks",
    "identity", "requirements", "before", "foreword", "stage", "first", "second", "third", "method", "movements", "movement", "such", "thus", "must",
    "should", "may", "still", "another", "same", "becomes", "develops",
)

PROSE_MARKS = (
    "は", "を", "が", "ます", "です", "から", "ので", "ため", "について", "により", "説明", "次の", "参照", "ました", "である", "します", "して", "など", "という", "場合", "時の", "如く", "ように",
    "ながら", "つつ", "によ", "以上", "その", "この", "これ", "それ", "逃げ", "返す", "おさえ", "押さえ", "出来", "含め", "移る", "移行", "要領", "稽古法", "注意", "持た", "場面", "とき", "した時",
)

MOVEMENTS = ("素振り", "合わせ", "合せ", "突き", "打ち込み", "打ち", "返し", "流し", "巻き", "払い", "受け", "張り", "切り", "斬り", "段")
MOVEMENT_WORDS = ("suburi", "awase", "tsuki", "uchikomi", "uchi", "kaeshi", "nagashi", "tsuburi", "kata")
