"""Graph fixtures: edges as text, a third number being the weight."""

# Small graphs of which results are known elsewhere, so that equal results show equal rules.
W1 = "1,2 2,3 3,4 4,5 5,6"
W2 = W1 + " 7,8 8,9"
W3 = W2 + " 10,11 11,12 12,10 10,13 13,14"
W4 = (
    "1,2 2,3 3,4 4,5 5,6 25,6 880,25 15,24 655,24 900,655 400,15 900,33 7,8 8,9 0,198 435,44 9,0 44,8 10,11 11,12 12,10 10,13 13,14"
)
C2 = "1,2 1,3 1,4 1,5 2,3 2,4 2,1 2,3 3,1 3,2"
C3 = "1,2 1,3 1,4 1,5 1,6 2,3 2,4 2,5 3,4 3,5 4,5 6,1 6,7 6,8 6,9 7,8 7,9 8,9 9,8 9,7 5,2 5,4 4,2"
C4 = (
    "1,2 2,3 3,4 4,5 5,6 25,6 880,25 25,880 880,6 6,25 6,880 15,24 655,24 900,655 400,15 900,33 7,8 8,9 0,198 435,44 9,0 44,8 7,9 8,7 9,7 9,8 "
    "10,11 11,12 12,10 10,13 13,14 11,10 10,12 12,11"
)
F1 = (
    "1,2 1,3 1,4 1,5 1,6 2,3 2,4 2,5 2,1 3,4 3,5 3,20 3,1 3,2 4,5 4,1 4,2 4,3 5,1 5,2 5,3 5,4 6,1 6,8 8,6 8,10 10,8 10,12 12,10 15,17 15,19 17,15 19,15 "
    "19,20 20,3 20,19"
)
F2 = "1,2 4,3 28,16"
F3 = "fir,elm elm,fir oak,elm elm,oak fir,oak oak,fir oak,ash ash,yew"
P3 = "1,2 2,1 2,3 3,2 3,1 1,3"
P4 = C3.replace(" 5,4 4,2", "")
L2 = W1 + " 10,16 10,11 10,12 10,13 10,14 10,15"
L4 = "1,2 1,3 1,4 1,5 1,6 2,3 2,4 2,5 3,4 3,5 4,5 6,7 6,8 6,9 7,8 7,9 8,9"
L6 = "1,2 2,1 1,3 3,1 2,3 3,2"


def pairs(text, kind=int):
    out = []
    for e in text.split():
        p = e.split(",")
        out.append((kind(p[0]), kind(p[1]), int(p[2]) if len(p) > 2 else 1))
    return out


def graph(spark, text, kind=int):
    return spark.createDataFrame(pairs(text, kind), f"src {'bigint' if kind is int else 'string'}, dst {'bigint' if kind is int else 'string'}, weight bigint")
