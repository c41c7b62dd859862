"""IRIs, code lists and null markers that results must agree with."""

# RDF terms, as prefix + local name. Case matters and differs per source.
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
LOCN = "http://www.w3.org/ns/locn#"
ADMS = "http://www.w3.org/ns/adms#"
SKOS = "http://www.w3.org/2004/02/skos/core#"
DCT = "http://purl.org/dc/terms/"
PROV = "http://www.w3.org/ns/prov#"
GEO = "http://www.opengis.net/ont/geosparql#"
GEBOUW = "https://data.vlaanderen.be/ns/gebouw#"
ADRES = "https://data.vlaanderen.be/ns/adres#"
INFRA = "https://data.vlaanderen.be/ns/cultuur-en-jeugd/infrastructuur#"
PLATFORM = "https://data.uitwisselingsplatform.be/ns/platform#"

RDF_TYPE = RDF + "type"

# Classes counted by the subject count, per kind of graph.
NAMED_GRAPH_CLASSES = [GEBOUW + "Gebouw", DCT + "Location"]
DEFAULT_GRAPH_CLASSES = [GEBOUW + "Gebouw", INFRA + "Infrastructuur", INFRA + "Buitenruimte"]

# Fixed value: the source label of records taken from the event-places store.
PLACES_SOURCE = (
    "https://data.uitwisselingsplatform.be/"
    "be.publiq.vrijetijdsparticipatie/publiq-uit-locaties/placessparql"
)

# Catalogue types that are kept, and the location type each one stands for.
TYPE_MAPPING = {
    "https://taxonomy.uitdatabank.be/terms/Yf4aZBfsUEu2NsQqsprngw":
        "http://infrastructuur.dcjm.be/id/type#cultuurOfGemeenschapcentrum",
    "https://taxonomy.uitdatabank.be/terms/kI7uAyn2uUu9VV6Z3uWZTA":
        "http://infrastructuur.dcjm.be/id/type#bibliotheek",
    "https://taxonomy.uitdatabank.be/terms/GnPFp9uvOUyqhOckIFMKmg":
        "http://infrastructuur.dcjm.be/id/type#museum",
    "https://taxonomy.uitdatabank.be/terms/8.70.0.0.0":
        "http://infrastructuur.dcjm.be/id/type#podiumkunstinfrastructuur",
    "https://taxonomy.uitdatabank.be/terms/BtVNd33sR0WntjALVbyp3w":
        "http://infrastructuur.dcjm.be/id/type#bioscoop",
}

# Ids under quarantine.
QUARANTINE = [
    "https://data.publiq.be/places/61bb6b32-141e-4c38-97b0-7c93549e7133",
    "https://data.publiq.be/places/07cf730e-a31c-41f0-83a7-6ab3b873edf9",
    "https://data.publiq.be/places/2f4ad0a8-1ffd-40a5-8c24-d27f9b871fad",
    "https://data.publiq.be/places/26d9fc9c-f8cf-4bc3-afab-e6a09bc332cb",
    "https://data.publiq.be/places/00bd9182-eae0-4a8b-be79-8d520f985145",
    "https://data.publiq.be/places/8a72eb30-d0d1-4dc1-9690-efb55a14d28f",
    "https://data.publiq.be/places/c4c1dc40-8108-4ed2-9f6e-32095a58ee5f",
    "https://data.publiq.be/places/d3d630ce-7484-4a85-ab43-b3d0396f9e74",
    "https://data.publiq.be/places/808f6eb9-8c5b-4e83-89a3-9136a46571b7",
    "https://data.publiq.be/places/7dc70ac8-1c12-4750-8cdd-5ad1c6f24920",
    "https://data.publiq.be/places/19e5f267-393f-4643-8278-e55142671319",
    "https://data.publiq.be/places/314f3f0e-dfcf-4a4e-9ea8-279d01e7f63f",
    "https://data.publiq.be/places/37a4378f-8b2b-471c-9081-b211ff63d9f7",
]

# Cell texts that mean "no value" in the CSV files.
NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
