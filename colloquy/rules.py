"""Word lists, title rules and patterns that results depend on. Patterns are Java regular expressions."""

from __future__ import annotations

# Fixed values. Title rules in order: (pattern, agency). The current rules are compared by where they match; the earlier ones by order.
CABINET = "内閣府・内閣官房等"
TITLE_RULES = (
    ("経済産業|通商産業|資源エネルギー庁|中小企業庁|特許庁", "経済産業省"),
    ("厚生労働|厚生省|労働省", "厚生労働省"),
    ("文部科学|文部省|科学技術庁|スポーツ庁|文化庁", "文部科学省"),
    ("総務省|総務大臣|自治省|郵政省|消防庁", "総務省"),
    ("財務省|財務大臣|大蔵省|国税庁", "財務省"),
    ("金融庁|金融担当|特命担当大臣[（(]金融[）)]", "金融庁"),
    ("外務省|外務大臣", "外務省"),
    ("法務省|法務大臣|出入国在留管理庁", "法務省"),
    ("農林水産|農林省|水産庁|林野庁", "農林水産省"),
    ("国土交通|運輸省|建設省|観光庁|気象庁|海上保安庁", "国土交通省"),
    ("環境省|環境庁|環境大臣", "環境省"),
    ("防衛省|防衛庁|自衛隊", "防衛省"),
    ("デジタル庁|デジタル大臣", "デジタル庁"),
    ("こども家庭庁|こども政策担当|少子化対策担当", "こども家庭庁"),
    ("個人情報保護委員会", "個人情報保護委員会"),
    ("内閣府|内閣官房|内閣総理大臣|官房長官|国家公安委員会|警察庁|消費者庁|公正取引委員会", CABINET),
)
EARLY_TITLE_RULES = (
    ("経済産業|通商産業|資源エネルギー庁|中小企業庁|特許庁", "経済産業省"),
    ("厚生労働|厚生省|労働省|医薬品医療機器総合機構", "厚生労働省"),
    ("文部科学|文部省|科学技術庁|スポーツ庁|文化庁", "文部科学省"),
    ("総務省|自治省|郵政省|消防庁", "総務省"),
    ("財務省|大蔵省|国税庁", "財務省"),
    ("外務省|外務大臣", "外務省"),
    ("法務省|法務大臣|出入国在留管理庁", "法務省"),
    ("農林水産|農林省|水産庁|林野庁", "農林水産省"),
    ("国土交通|運輸省|建設省|観光庁|気象庁|海上保安庁", "国土交通省"),
    ("環境省|環境庁", "環境省"),
    ("防衛省|防衛庁|自衛隊", "防衛省"),
    ("デジタル庁|デジタル大臣", "デジタル庁"),
    ("こども家庭庁|こども政策担当|少子化対策担当", "こども家庭庁"),
    ("内閣府|内閣官房|内閣総理大臣|官房長官|国家公安委員会|警察庁|消費者庁|公正取引委員会", CABINET),
)

# Fixed values. Who speaks.
CHAIR = "委員長|議長|会長|座長"
CHAIR_HEADER = r"^[○〇][^\s。]{0,60}?(?:委員長|議長|会長|座長)(?:代理)?(?:\([^)]{0,50}\))?(?:\s|$)"
GOVERNMENT = "大臣|副大臣|政務官|政府参考人|長官|局長|審議官|統括官"
EARLY_CHAIR = "委員長|議長|副委員長|理事"
EARLY_GOVERNMENT = "大臣|副大臣|政務官|政府参考人|政府特別補佐人|長官|局長|審議官|統括官"
ROUTE_NOT_LEGISLATOR = "委員長|議長|副委員長|理事|大臣|副大臣|政務官|政府参考人"
QUESTION_LIKE = "伺い|お聞き|質問|どう|なぜ|見解|お答え|いかが|でしょうか|ですか|か。"
ASKS = r"[?？]|伺|お尋ね|いかが|どう|所見|べき|問う|質問|教示|答え"
ASKS_NOT = "質問しません|質問ではありません"
ASKS_ANYWAY = r"[?？]|伺|お尋ね"
CUES = r"[?？]|伺|お尋ね|教示"
PLENARY, PRIME_MINISTER = "本会議", "内閣総理大臣"
NO_ANSWER = "拍手|登壇"
UNNAMED = "答弁者"

# Fixed values. In what capacity an answer is given.
CAPACITY = "(?:として|では|において|からは|といたしましては)"
CAPACITY_OF_OTHERS = "(?:所管の|担当の|関係する|連携する|対して|による|ですが、)"
CAPACITY_OF_SELF = "(?:私ども|我々|当省|当庁)"

# Fixed values. How text is cut.
SENTENCE_END = r"[。！？?]|(?:次に|続いて|それでは)[、，]"
TOPIC_SHIFT = r"^\s*(?:次に|続いて|それでは)[、，]"
PART_SENTENCE = "[^。！？?]+[。！？?]?"
SPEAKER_HEADER = r"^[○〇][^ ]{1,60}\s+"
GREETINGS = (
    r"^(?:はい[、。 ]*)?(?:お答え(?:を)?(?:申し上げ|いたし|し)ます|御指摘ありがとうございます|ありがとうございます|御指摘のとおりでございます|よろしくお願いいたします)[。 ]*$",
    r"^(?:委員|先生)(?:に|の御質問に|のご質問に)お答え(?:を)?(?:申し上げ|いたし|し)ます[。 ]*$",
    r"について(?:の)?(?:お尋ね|御質問|ご質問)(?:です|でございます|がありました)[。 ]*$",
)
ENTITY_SUFFIX = r"(?:[\p{IsHan}等]{0,16})?(?:法|令|規則|機構|省|庁|委員会|審議会|部会|協会)(?=[^\p{IsHan}]|$)"
KATAKANA = r"[\p{IsKatakana}ー]"
# Letters of the Han script below U+10000, for patterns of Python, which know no scripts.
HAN = "⺀-⻳⼀-⿕々〇〡-〩〸-〻㐀-䶿一-鿿豈-﫿"

# Fixed values. Words that say nothing about the topic.
FILLER = (
    "について", "における", "による", "に関する", "として", "ため", "政府", "どのよう", "どう", "こと", "もの", "これ", "それ", "何", "どこ", "また", "さらに", "及び", "並びに",
    "より", "から", "ある", "する", "いる", "れる", "政策", "対応", "質問", "現在", "今後", "我が国", "日本", "促進", "推進", "進める", "検討", "べき", "では", "ない", "すべ",
    "強化", "必要", "見直し", "拡大", "拡充", "支援", "改善", "整備", "充実", "進め", "いかが", "でしょう", "ます", "ください", "お願い", "伺い", "お伺い", "お尋ね", "対策", "活躍",
    "分野", "領域", "業界", "あり方", "在り方", "どの", "よう", "どんな", "いかなる", "なぜ", "行って", "行う", "行い", "いるか", "いく", "図る", "図って", "伺う", "お聞き",
    "考えて", "考える", "取り組む", "取り組んで", "されて", "されています", "でしょうか", "なって", "なります",
)
TRAINING_STOPWORDS = (
    "について", "として", "ため", "政府", "どのよう", "どう", "こと", "もの", "これ", "それ", "また", "さらに", "及び", "並びに", "より", "から", "ある", "する", "いる", "れる",
    "政策", "対応", "質問", "現在", "今後", "我が国", "日本", "促進", "必要", "考え",
)
TOOL_STOPWORDS = (*TRAINING_STOPWORDS, "ください", "でしょう")
ROUTE_STOPWORDS = (
    "について", "として", "ため", "政府", "どのよう", "どう", "こと", "もの", "これ", "それ", "何", "どこ", "また", "さらに", "及び", "並びに", "より", "から", "ある", "する",
    "いる", "れる", "政策", "対応", "質問", "現在", "今後", "我が国", "日本", "促進",
)
TOKEN = "[一-龥ぁ-んァ-ヶA-Za-z0-9０-９]{2,}"
DIGITS = "[0-9０-９]+"
BRIDGE_GENERIC = ("説明", "確認", "内容", "制度", "取組", "考え", "認識", "指摘", "御指摘", "所見")
REPLY_GENERIC = "^(お答え|御指摘|指摘|承知|認識|考え|取組|取り組み|実施|実行|内容|制度|委員|提案|所存)"
BACK_REFERENCE = "御指摘|おっしゃ|その点|その取組|本件"

# Fixed values. What a draft question may be wrapped in.
REQUEST_SUFFIX = r"(?:について|に関して)(?:詳しく|具体的に)?教えて(?:ください|下さい)[。．.!！?？]*$"
SHOULD = f"を([{HAN}]{{2,4}})(?:する|す)?べき"
SHOULD_GENERIC = ("検討", "議論", "考慮", "実施")

# Fixed values. Laws that set up an agency.
DEPARTMENTS = ("経済産業省", "厚生労働省", "文部科学省", "総務省", "財務省", "金融庁", "外務省", "法務省", "農林水産省", "国土交通省", "環境省", "防衛省", "デジタル庁", "こども家庭庁", "個人情報保護委員会")
LAW_KINDS = ("設置法", "組織令", "組織規則")
CABINET_LAWS = ("内閣府設置法", "内閣府本府組織令", "内閣府本府組織規則")
LAW_CUE = "に関すること"
LAW_URL = "https://laws.e-gov.go.jp/law/"
LAW_TYPES = ("Act", "CabinetOrder", "MinisterialOrdinance")

# Fixed values. A provider's error codes.
KNOWN_CODES = (3003, 3006, 3007, 3008, 3023, 3036, 3039, 3040, 3041, 3042, 5004, 5005, 5007, 5016, 5018, 5019, 5035)
QUOTA_CODES, BUSY_CODES, INPUT_CODES, TIMEOUT_CODES, ACCESS_CODES = (3036,), (3040,), (3006,), (3007, 3008), (3023, 3041, 5016, 5018, 5035)
QUOTA_WORDS = r"daily[^\n]{0,100}(?:neuron|free allocation)"
BUSY_WORDS = r"\brate[ _-]*limit|capacity temporarily|\bbusy\b|overloaded"
INPUT_WORDS = r"context.{0,30}(?:limit|length|window)|input.{0,30}token.{0,30}limit|request too large"
TIMEOUT_WORDS = "timeout|timed out"

# Fixed values. Closed sets of a review.
DECISIONS = ("accept", "reject", "uncertain")
RELATIONS = ("same", "broader", "provider_only", "different", "unclear")
