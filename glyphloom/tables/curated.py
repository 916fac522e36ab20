"""Curated word lists of the detectors."""

from __future__ import annotations

# Names that look-alike packages and accounts imitate, in order of search.
TARGETS = """
Nethereum ethereum ethers web3 bitcoin uniswap metamask binance coinbase solana
react react-dom next vue angular lodash express electron typescript webpack node-fetch discord.js crypto-js
django requests flask numpy pandas tensorflow pytorch matplotlib scipy beautifulsoup4 pyyaml cryptography
serde tokio clap reqwest rand anyhow
rails rspec devise nokogiri
google amazon microsoft apple github gitlab bitbucket cloudflare stripe twilio paypal openai anthropic claude chatgpt tesla
twitter facebook instagram tiktok telegram discord
""".split()

# Words and phrases that generated prose favours, in order of search.
FAVOURED = (
    "delve", "delving", "tapestry", "intricate", "nuanced", "moreover", "furthermore", "realm", "elucidate", "showcasing", "underscores",
    "underscored", "pivotal", "bolster", "multifaceted", "testament", "foster", "holistic", "paradigm", "transformative", "spearhead",
    "meticulous", "meticulously", "empower", "empowering", "profound", "profoundly", "compelling", "comprehensive", "crucial", "daunting",
    "robust", "streamline", "enrich", "exemplify", "captivating", "discerning", "mesmerize", "intricately", "imbue", "plays a crucial role",
    "plays a pivotal role", "it is important to note", "it is worth noting", "in conclusion", "in essence", "delve into", "delving into",
    "tapestry of", "realm of",
)

# Tokens that language models of one vocabulary could not handle; leading spaces count.
GLITCH_TOKENS = (
    " SolidGoldMagikarp", " StreamerBot", " davidjl", " RandomRedditor", " RandomRedditorWithNo", " attRot", " newcom",
    " cloneembedreportprint", " rawdownload", " rawdownloadcloneembedreportprint", " SpaceEngineers", " externalToEVA", " externalToEVAOnly",
    " reportprint", " embedreportprint", " cloneembedreportprintRAW", " 龍喚士", " TheNitrome", " TheNitromeFan", " GoldMagikarp",
    " DragonMagazine", " Skydragon", " Adinida", " Mechdragon", " iHUD", " PsyNetMessage", " strutConnector", " srfN", " largeDownload",
    " InstoreAndOnline", " BuyableInstoreAndOnline", " quickShip", " quickShipAvailable", " oreAndOnline", " petertodd", " disclaim",
    " inentional", " reportedlydeclared",
)

# Named schemes and the cue they leave.
WATERMARK_SCHEMES = (("KGW", "green_list_bias"), ("Aaronson", "pseudorandom_seq"), ("ChristGunnZamir", "pseudorandom_seq"))
