"""Word lists that detection and aliases go by.

A Lexicon is a parameter of everything that uses one; DEFAULT holds the fixed values below. Lists only need the words,
upper-cased where they are compared; entries of several words or with dots can't equal a word token and are left out.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# Fixed values ---------------------------------------------------------------------------------------------------------

STOP_WORDS_FR = """
de la le les un une des du au aux et ou mais donc car ni que qui quoi dont où ce cette ces mon ma mes ton ta tes son sa
ses notre nos votre vos leur leurs je tu il elle nous vous ils elles on me te se lui y en dans sur sous avec sans pour
par entre vers chez est sont a ont fait dit être avoir faire pouvoir devoir vouloir aller venir voir savoir falloir plus
moins très bien mal aussi comme même tout toute tous toutes autre autres aucun aucune chaque pas ne jamais toujours
encore déjà ici là alors ainsi puis ensuite après avant depuis pendant quand si non oui peut été ces était serait sera
ferait avait faut cela ceci celle celui ceux celles certains certaines quel quelle quels quelles lequel laquelle lesquels
lesquelles peu beaucoup trop assez tel telle tels telles lors dès hors selon contre malgré parmi afin car or soit tant
tel via ci là ça soi autrui chacun chacune quelque quelques plusieurs nul nulle rien personne point guère comment
pourquoi combien partout ailleurs dessus dessous dedans dehors devant derrière autour loin près tard tôt parfois souvent
maintenant hier demain aujourd hui longtemps aussitôt bientôt surtout seulement environ plutôt néanmoins pourtant
cependant toutefois tandis puisque lorsque quoique sinon autant davantage autrement désormais dorénavant jadis naguère
certes volontiers hélas soit
"""
STOP_WORDS_EN = """
the a an and or but in on at to for of with by from as is was are were been be have has had do does did will would shall
should may might can could must not no nor so if then than that this these those it its he she they we you i me him her
us them my your his our their what which who whom where when why how all each every both few more most other some such
only own same very just about above after again also any because before between during here there into through under
until up down out over being having doing going coming making taking giving getting saying knowing thinking seeing
wanting using finding telling asking working seeming leaving calling trying needing becoming keeping beginning showing
hearing playing running moving living believing bringing happening writing sitting standing losing paying meeting
including continuing setting learning changing leading understanding watching following stopping creating speaking
reading allowing adding spending growing opening walking winning offering remembering considering appearing buying
waiting serving dying sending building staying falling cutting reaching killing remaining suggesting raising passing
selling requiring reporting deciding pulling
"""
STOP_WORDS_DE = """
der die das ein eine und oder aber in auf an zu für von mit bei nach aus um über vor zwischen durch gegen ohne bis ist
sind war waren hat haben wird werden kann können muss müssen soll sollen darf dürfen nicht kein keine auch noch schon
wenn als wie so da dann dort hier ich du er sie es wir ihr mein dein sein unser euer dieser diese dieses jener jene jenes
welcher welche welches was wer wo wann warum wie ob dass weil damit obwohl während nachdem bevor seit bis falls indem
sowohl weder noch doch denn nämlich zwar jedoch trotzdem deshalb daher darum deswegen außerdem übrigens allerdings
immerhin jedenfalls schließlich eigentlich tatsächlich selbst sogar eben halt mal nun gerade bereits fast etwa ungefähr
ziemlich recht ganz sehr viel wenig mehr weniger am beim zum vom im ins ans aufs ums hinter neben unter über vor zwischen
hinein heraus hinauf hinunter hinüber herein herunter vorbei entlang gegenüber innerhalb außerhalb oberhalb unterhalb
diesseits jenseits beiderseits abseits längs mittels zwecks anhand aufgrund infolge anstatt anstelle mithilfe zufolge
zugunsten zulasten jemand niemand etwas nichts alles alle einige manche mehrere beide andere solche welche jede jeder
jedes viele wenige
"""
LEGAL_FORMS = """
SCI SARL SAS SA EURL SASU GIE SNC SCA SCOP SCEA SEL SELARL SELAS LTD LIMITED PLC LLP CIC CIO LP GMBH AG KG OHG EV UG SE
LLC INC INCORPORATED CORP CORPORATION PLLC PA PC LTDA EIRELI MEI EPP ME
"""
COMPANY_WORDS = """
SOCIETE SOCIÉTÉ GROUPE COMPAGNIE ETABLISSEMENT ÉTABLISSEMENT FONDATION ASSOCIATION COMPANY GROUP HOLDINGS PARTNERS
ASSOCIATES FOUNDATION TRUST GESELLSCHAFT VEREIN STIFTUNG GENOSSENSCHAFT KONZERN EMPRESA GRUPO COMPANHIA FUNDAÇÃO
ASSOCIAÇÃO
"""
STREET_WORDS = """
RUE AVENUE BOULEVARD PLACE IMPASSE ALLÉE ALLEE CHEMIN PASSAGE COURS ROUTE SQUARE QUAI SENTIER CITÉ CITE VILLA VOIE
TRAVERSE MONTÉE MONTEE RUELLE STREET ST ROAD RD AVE LANE LN DRIVE DR COURT CT PL TERRACE CLOSE WAY CRESCENT CIRCLE BLVD
HIGHWAY HWY STRASSE STR STRAßE WEG GASSE PLATZ RING DAMM UFER CHAUSSEE STEIG PFAD
"""
HONORIFICS = "M MR MME MLLE DR ME PR MRS MS MISS PROF SIR LADY HERR FRAU"

FIRST_NAMES = """
Marc Antoine Julien Thomas Paul Lucas Hugo Louis Arthur Nathan James William Oliver Henry George Pierre François
Alexandre Nicolas Philippe Vincent Mathieu Christophe Laurent Sébastien Étienne Benoît Maxime Adrien Romain Rémi Florian
Damien Cédric Yannick Arnaud Jérôme Grégoire Thibault Quentin Raphaël Gabriel Léon Charles Victor Jules Théo Adam Noah
Liam Sophie Claire Émilie Laura Julie Alice Charlotte Léa Emma Sarah Emily Grace Lily Amelia Marie Isabelle Catherine
Nathalie Véronique Céline Aurélie Stéphanie Caroline Valérie Pascale Sandrine Delphine Mélanie Justine Margaux Camille
Manon Chloé Inès Zoé Louise Jade Lina Mila Anna Eva Lucie Pauline Agathe Mathilde Élise Juliette Clémence Victoire Adèle
"""
NEUTRAL_NAMES = "Camille Dominique Claude Alex Sam Charlie Robin Maxime Alix Louison Noa Eden Sacha Andréa Morgan"
SURNAMES = """
Renaud Blanchard Lecomte Marechal Collet Picard Navarro Lemoine Barbier Gérard Humbert Maillard Cordier Bouvier Tessier
Perrin Mercier Fabre Roussel Fontaine Chevalier Legrand Robin Garnier Moulin Giraud Boucher Carpentier Delorme Guérin
Berger Marchand Rivière Leclerc Noël Aubert Poulain Clément Rey Gautier Lacroix Brun Prévost Meunier Gaillard Rossignol
Verdier Charpentier Vidal Masson Smith Johnson Brown Taylor Wilson Moore Clark Hall Young King Wright Walker Allen
Mitchell Carter Phillips Turner Parker Edwards Collins Stewart Morris Rogers Reed Cook
"""
COMPANY_PREFIXES = "Euro Groupe Alliance Horizon Apex Nova Stellar Atlas Global Prime Néo Vital Optima Synergis Vertex"
COMPANY_SUFFIXES = """
Solutions Services Conseil Investissement Développement Capital Industries Technologies Patrimoine Gestion Partners
Consulting Management Finance Immobilier
"""
COMPANY_NAMES = """
Horizon Étoile Méridien Solaris Boréal Azur Opale Cristal Zénith Aurore Belvédère Rivage Altitude Latitude Équinoxe
"""
CITIES = """
Bordeaux Nantes Strasbourg Montpellier Rennes Lille Reims Toulon Grenoble Dijon Angers Clermont-Ferrand Brest Tours
Amiens Metz Perpignan Orléans Caen Rouen Manchester Birmingham Bristol Leeds Glasgow Munich Hamburg Cologne Frankfurt
Stuttgart
"""
STREET_KINDS = ["rue", "avenue", "boulevard", "place", "chemin"]
STREET_NAMES = [
    "des Tilleuls", "du Commerce", "Victor Hugo", "de la Paix", "Jean Jaurès", "Pasteur", "Gambetta", "de la Gare",
    "des Lilas", "du Marché", "de la République",
]
MAIL_DOMAINS = ["email.fr", "courrier.net", "boite.org", "exemple.com"]
URL_DOMAINS = ["exemple.fr", "site-web.com", "page.org", "portail.net"]
URL_PATHS = ["page", "doc", "info", "contenu", "ressource"]
#: Legal forms that an alias keeps when a company's name begins with one.
KEPT_FORMS = "SCI SARL SAS SA EURL SASU LLC LTD GMBH AG INC CORP"

# ----------------------------------------------------------------------------------------------------------------------


def upper(words: str) -> list[str]:
    """Distinct upper-case words of a list, in order."""
    return list(dict.fromkeys(w.upper() for w in words.split()))


@dataclass(frozen=True)
class Lexicon:
    """stop_words: language -> upper-case words, in the order in which languages win ties; the others are upper-case words."""

    stop_words: dict[str, list[str]] = field(default_factory=lambda: {"fr": upper(STOP_WORDS_FR), "en": upper(STOP_WORDS_EN), "de": upper(STOP_WORDS_DE)})
    company_words: list[str] = field(default_factory=lambda: upper(LEGAL_FORMS + COMPANY_WORDS))
    street_words: list[str] = field(default_factory=lambda: upper(STREET_WORDS))
    honorifics: list[str] = field(default_factory=lambda: upper(HONORIFICS))

    @property
    def every_stop_word(self) -> list[str]:
        return list(dict.fromkeys(w for words in self.stop_words.values() for w in words))


DEFAULT = Lexicon()
